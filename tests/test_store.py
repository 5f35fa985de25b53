"""The bucketed store, the markdown stream, and searches over a stored index."""

import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.functions import extensions as U, fixed_values as fv
from corpusq.operators import answering as A, indexing as IX, retrieval as R, search_store as SS, vector_index as VI
from corpusq.operators.chunks import chunk_documents, clean_documents
from corpusq.plans import fetch, vectors as V
from corpusq.plans.scratch import FREE_SHUFFLES, keep, shared_folder
from corpusq.streaming import jobs as J
from corpusq.operators.records import apply_changes
from corpusq.streaming.store import CHUNK_COLUMNS, PathStore, RecordStore

EVENT = "doc_path string, text string, op string, seq bigint"


def text_of(path, n):
    return f"# Title {path}\n\nText {n} of {path}. " + "Some words follow here. " * (n % 5 + 1)


def held(df):
    return sorted((r["doc_path"], r["chunk_id"], r["text"]) for r in df.select("doc_path", "chunk_id", "text").collect())


def expected(spark, last):
    docs = spark.createDataFrame([(p, t) for p, t in sorted(last.items()) if t is not None], "doc_path string, text string")
    return held(chunk_documents(clean_documents(docs)))


def input_bytes(*frames):
    return sum(os.path.getsize(f.removeprefix("file://")) for df in frames for f in set(df.inputFiles()))


def test_batches_cost_the_same_however_many_there_were(spark):
    store, last, read = shared_folder(spark, "store"), {}, {}
    first = [(f"d{i}", text_of(f"d{i}", 0), "upsert", 0) for i in range(24)]
    batches = [first] + [[(f"d{(7 * b + k) % 24}", text_of(f"d{(7 * b + k) % 24}", b), "upsert", b) for k in range(2)] for b in range(1, 12)]
    batches[6].append(("d1", None, "remove", 6))
    batches[9].append(("d1", text_of("d1", 99), "upsert", 3))  # late: after the removal by arrival, before it by seq
    for b, rows in enumerate(batches):
        J.ingest_batch(spark.createDataFrame(rows, EVENT), b, store, buckets=8, compact_after=3)
        for path, text, op, seq in rows:
            if not (path == "d1" and seq == 3 and b == 9):
                last[path] = text
        kept = PathStore(spark, store)
        read[b] = input_bytes(kept.read("versions"), kept.read("chunks"))
        assert len(kept.tail()) < 3 and (kept.buckets == 8 or b < 3)
    assert held(J.current_chunks(spark, store)) == expected(spark, last)
    assert read[11] <= 2 * read[4]
    # replays: one in the tail, one in the base, one with nothing new
    before = held(J.current_chunks(spark, store))
    for b in (11, 8, 2):
        J.ingest_batch(spark.createDataFrame(batches[b], EVENT), b, store, buckets=8, compact_after=3)
    assert held(J.current_chunks(spark, store)) == before
    # files that no manifest names are gone
    base = os.listdir(store.removeprefix("file:") + "/base/chunks")
    assert len([n for n in base if n.startswith("v=")]) <= 5


def test_a_lookup_reads_the_buckets_of_its_paths(spark):
    store = shared_folder(spark, "store")
    rows = [(f"d{i}", text_of(f"d{i}", i), "upsert", 0) for i in range(40)]
    J.ingest_batch(spark.createDataFrame(rows, EVENT), 0, store, buckets=16, compact_after=1)
    kept = PathStore(spark, store)
    found = kept.chunks_of(["d7"])
    assert held(found) == expected(spark, {"d7": text_of("d7", 7)})
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in found.inputFiles()}
    assert len(files) == 1 and len({v for k, v in kept.base.items()}) == 1
    # a batch that touches one bucket writes one bucket anew
    J.ingest_batch(spark.createDataFrame([("d7", text_of("d7", 8), "upsert", 1)], EVENT), 1, store, buckets=16, compact_after=1)
    after = PathStore(spark, store)
    assert sorted(b for (k, b), v in after.base.items() if k == "chunks" and v == after.number) == kept.touched(
        spark.createDataFrame([("d7",)], "doc_path string"))
    assert held(after.chunks_of(["d7", "no such path"])) == expected(spark, {"d7": text_of("d7", 8)})


def test_batches_carry_labels_counts_and_vectors(spark):
    store, options = shared_folder(spark, "store"), {"buckets": 4, "compact_after": 1, "more": IX.ENRICHED}
    embed = U.register_embedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    last = {f"d{i}": text_of(f"d{i}", i) for i in range(6)}
    batches = [list(last.items()), [("d1", "Dice pool test of the d1. Example: none."), ("d2", None)]]
    for b, rows in enumerate(batches):
        events = [(p, t, "upsert" if t else "remove", b) for p, t in rows]
        J.ingest_batch(spark.createDataFrame(events, EVENT), b, store, enrich=lambda c: IX.enrich_chunks(c, embed), **options)
        last.update(rows)
    docs = spark.createDataFrame([(p, t) for p, t in last.items() if t], "doc_path string, text string")
    want = IX.enrich_chunks(chunk_documents(clean_documents(docs)), embed)
    names = ["chunk_id", "text", *[f.split()[0] for f in IX.ENRICHED.split(", ")]]
    got = J.current_chunks(spark, store, IX.ENRICHED)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))


def test_a_failing_embedder_is_no_result(spark):
    def one_by_one():
        def model(texts):
            if len(texts) > 1:
                raise ValueError("too many at once")
            return [[float(len(texts[0])), 1.0]]
        return model

    def fails_on_d3():
        def model(texts):
            if any("d3" in t for t in texts):
                raise ValueError("no such model")
            return [[float(len(t)), 1.0] for t in texts]
        return model
    docs = spark.createDataFrame([(f"d{i}", "lib", text_of(f"d{i}", i)) for i in range(6)], "doc_path string, source string, text string")
    made = docs.select(F.length("text").alias("n"), U.register_embedder(one_by_one, 2)("text").alias("v")).collect()
    assert len(made) == 6 and all(r["v"] == [float(r["n"]), 1.0] for r in made)
    with pytest.raises(Exception, match="no vector for the text that begins with.*no such model"):
        IX.index_documents(docs, U.register_embedder(fails_on_d3, 2), lexicon=[], patterns=[])
    for wrong in (lambda texts: [[] for _ in texts], lambda texts: [None for _ in texts], lambda texts: [[1.0, 2.0, 3.0] for _ in texts], lambda texts: []):
        with pytest.raises(Exception, match="no vector for the text"):
            docs.select(U.register_embedder(lambda wrong=wrong: wrong, 2)("text")).collect()


def test_an_unfinished_compaction_changes_nothing(spark):
    store = shared_folder(spark, "store")
    for b in range(3):
        J.ingest_batch(spark.createDataFrame([(f"d{b}", text_of("x", b), "upsert", b)], EVENT), b, store, buckets=4, compact_after=100)
    before = held(J.current_chunks(spark, store))
    kept = PathStore(spark, store)
    os.makedirs(store.removeprefix("file:") + "/manifest/000000001")  # begun, not complete
    assert held(PathStore(spark, store).chunks()) == before
    kept.compact()
    assert PathStore(spark, store).compacted == 2 and held(J.current_chunks(spark, store)) == before


def test_markdown_folder_as_a_stream(spark, tmp_path):
    folder, store = tmp_path / "books", shared_folder(spark, "store")
    (folder / "sub").mkdir(parents=True)
    checkpoint = store + "/checkpoint"

    def write(name, n):
        (folder / name).write_text(text_of(name, n))
        time.sleep(0.02)

    def run():
        J.stream_markdown(spark, str(folder), store, checkpoint, max_files=3, buckets=4, compact_after=3).awaitTermination()
        return held(J.current_chunks(spark, store))

    def wanted():
        return held(chunk_documents(clean_documents(spark.read.text(
            str(folder), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(
            F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text")))))
    for i in range(5):
        write(f"a{i}.md", i)
    write("sub/b c.md", 1)
    (folder / "notes.txt").write_text("not a book")
    assert run() == wanted()
    versions = PathStore(spark, store).versions().count()
    chunk_batches = {r["doc_path"]: r["chunk_batch"] for r in PathStore(spark, store).versions().collect()}
    write("a1.md", 50)          # changed
    write("a2.md", 2)           # written again, same text
    write("new.md", 3)
    assert run() == wanted()
    after = {r["doc_path"]: r["chunk_batch"] for r in PathStore(spark, store).versions().collect()}
    moved = {p.rsplit("/", 1)[1] for p in after if after[p] != chunk_batches.get(p)}
    assert versions == 6 and moved == {"a1.md", "new.md"}
    # what a stream cannot see: a file that is gone, and one that comes with an old time
    (folder / "a3.md").unlink()
    write("old.md", 4)
    os.utime(folder / "old.md", (1_000_000_000, 1_000_000_000))
    run()
    J.reconcile_markdown(spark, str(folder), store, 1000, buckets=4, compact_after=3)
    assert held(J.current_chunks(spark, store)) == wanted()
    assert CHUNK_COLUMNS[0] == "doc_path"


def test_record_snapshots_equal_the_whole_log(spark):
    rng = random.Random(6)
    ops = ["insert", "insert_or_ignore", "insert_or_replace", "update", "update", "delete"]
    base = spark.createDataFrame([(k, k, "b") for k in range(0, 20, 3)], "key int, n int, t string")
    log = [(0 if rng.random() < 0.3 else rng.randrange(22), seq, rng.choice(ops), rng.choice([None, rng.randrange(9)]), f"t{seq}") for seq in range(140)]
    batches = [log[i:i + 20] for i in range(0, 140, 20)]
    late = batches[3].pop(4)
    batches[4].append(late)  # one batch late: counts
    schema, root = "key int, seq int, op string, n int, t string", shared_folder(spark, "records")
    for b, rows in enumerate(batches):
        store = RecordStore(spark, root, base, "key", ["n", "t"], compact_after=2, keep=1)
        store.append(b, spark.createDataFrame(rows, schema))
        store.append(b, spark.createDataFrame(rows, schema))
    want = sorted(map(tuple, apply_changes(base, spark.createDataFrame(log, schema), "key", ["n", "t"]).collect()), key=repr)
    store = RecordStore(spark, root, base, "key", ["n", "t"])
    assert sorted(map(tuple, store.records().collect()), key=repr) == want and store.compacted >= 3 and len(store.tail()) <= 3
    # far too late, and a replay of a folded batch
    store.append(7, spark.createDataFrame([(log[0][0], 0, "delete", None, None)], schema))
    store.append(0, spark.createDataFrame(batches[0], schema))
    assert sorted(map(tuple, store.records().collect()), key=repr) == want


# ---- stored vectors
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 12)) * 3
    rows = [(i, [float(x) for x in np.float32(centres[0 if i % 3 == 0 else i % 30] + rng.normal(size=12))], i % 5) for i in range(1500)]
    rows += [(9000, None, 1), (9001, [0.0] * 12, 1), (9002, [], 1)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, section int").cache()


@pytest.fixture(scope="module")
def index(spark, vectors):
    path = shared_folder(spark, "index")
    VI.build_index(vectors, path, columns=("section",), cells=30, chunk_rows=100)
    return path


def near(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["question_id"], []).append((r["rank"], r["chunk_id"], round(r["distance"], 9)))
    return {q: sorted(v) for q, v in out.items()}


def test_index_recall_and_exact_way(spark, vectors, index):
    queries = vectors.filter("chunk_id % 7 = 0 or chunk_id >= 9000").select(
        F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query_embedding"), F.col("section").alias("want"))
    sound = queries.filter("question_id < 9000")
    for options in ({}, {"where": {"section": 2}}, {"per_query": {"section": "want"}}):
        exact = near(R.knn(sound, vectors.filter("chunk_id < 9000"), 6, **options))
        found = near(VI.search_index(queries, index, 6, **options))
        recall = np.mean([len({c for _, c, _ in exact[q]} & {c for _, c, _ in found.get(q, [])}) / len(exact[q]) for q in exact])
        assert recall >= 0.95 and all(len(v) <= 6 for v in found.values()) and not set(found) & {9000, 9001, 9002}
        assert near(VI.probe_index(queries, index, 6, 30, query_rows=40, **options)) == exact


def test_a_search_reads_probed_cells_only(spark, vectors, index):
    one = vectors.filter("chunk_id = 3").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query_embedding"))
    found = VI.probe_index(one, index, 3, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(\d+,\d+\)", plan) and found.count() == 3
    empty = shared_folder(spark, "index")
    VI.build_index(vectors.filter("false"), empty)
    assert VI.search_index(one, empty).count() == 0 and VI.search_index(one.filter("false"), index).count() == 0


def test_fetch_does_not_sort_the_table(spark, monkeypatch):
    table = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    ids = spark.createDataFrame([(5, "a"), (5, "b"), (77, "c"), (5000, "d"), (None, "e")], "k long, q string")
    want = [(5, "a", "text 5"), (5, "b", "text 5"), (77, "c", "text 77")]
    for limit in (fetch.HELD_IDS, 1):
        monkeypatch.setattr(fetch, "HELD_IDS", limit)
        found = fetch.fetch_rows(ids, table, "k")
        assert sorted(map(tuple, found.select("k", "q", "text").collect())) == want
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_are_picked_by_number_once_each(spark, monkeypatch):
    table = spark.range(0, 1000, 3).select(F.col("id").alias("n"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    table = table.unionByName(table.withColumn("n", F.col("n") + (1 << 33)))
    ids = spark.createDataFrame([(0,), (63,), (63,), (66,), (999,), (64,), (5000,), (None,), ((1 << 33) + 63,), ((1 << 33) + 64,)], "n long")
    want = [(0, "text 0"), (63, "text 63"), (66, "text 66"), (999, "text 999"), ((1 << 33) + 63, "text 63")]
    for limit in (fetch.HELD_IDS, 1):
        monkeypatch.setattr(fetch, "HELD_IDS", limit)
        assert sorted(map(tuple, fetch.pick_rows(ids, table, "n").collect())) == want


def test_kept_rows_leave_no_shuffle_files(spark):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    counted = spark.range(5000).groupBy((F.col("id") % 700).alias("g")).count()
    before, was = shuffled(), spark.conf.get(FREE_SHUFFLES)
    kept = keep(counted, "kept")
    assert not shuffled() - before and spark.conf.get(FREE_SHUFFLES) == was
    counted.write.parquet(shared_folder(spark, "plain"))
    assert shuffled() - before
    assert kept.count() == 700 and kept.dtypes == counted.dtypes


def answer_store(spark):
    """40 chunks of 10 documents; equal texts, a missing text and a link to a text that is a hit itself."""
    rows = []
    for d in range(10):
        for i in range(4):
            name, text = f"d{d}_{i}", None if (d, i) == (3, 1) else f"same words {i}" if d in (4, 5) else f"text {'abc'[d % 3] * (i + 1)} of {d}"
            rows.append((name, d * 4 + i, text, [1.0, float(d), float(i)], f"lib/src{d % 2}/d{d}.md", "rulebook" if d % 2 else None, "SR5" if d % 3 else "sr4",
                         "Gear" if d % 4 else None, "en", f"d{d}_s", i, f"d{d}_{i + 1}" if i < 3 else None, f"d{d}_{i - 1}" if i else None))
    return spark.createDataFrame(rows, "chunk_id string, text_id long, text string, embedding array<float>, source string, document_type string, edition string, "
                                 "primary_section string, subsection string, section_id string, chunk_index int, next_chunk_global string, prev_chunk_global string").withColumns(
        {"next_chunk_section": F.col("next_chunk_global"), "prev_chunk_section": F.col("prev_chunk_global")})


def test_answers_are_the_same_with_texts_kept_apart(spark):
    embed = U.register_embedder(lambda: lambda texts: [[1.0, float(len(t) % 9), float(t.count("a"))] for t in texts], 3)
    none = F.lit(None).cast("string")
    asked = spark.range(60).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("question_id"), F.concat(F.lit("ask "), F.repeat(F.lit("a"), (F.col("id") % 7).cast("int"))).alias("question"),
                                   (1 + F.col("id") % 4).cast("int").alias("n_results"), F.when(F.col("id") % 2 == 0, "rules").otherwise("nothing known").alias("query_type"),
                                   F.when(F.col("id") % 5 == 0, "rulebook").alias("filter_document_type"), none.alias("filter_edition"), F.when(F.col("id") % 3 == 0, "SR5").alias("edition"),
                                   F.when(F.col("id") % 4 == 0, "src1").when(F.col("id") % 4 == 1, "no such").alias("filter_source"), none.alias("character_role"), none.alias("filter_section"),
                                   none.alias("filter_subsection"), none.alias("character_stats"), none.alias("conversation_context"))
    asked = asked.unionByName(asked.filter("question_id = 'q8'"))
    templates = spark.createDataFrame([("general", "G {context}|{question}"), ("rules", "R {context}")], "query_type string, template string")
    whole = answer_store(spark)
    apart, texts = keep(whole.withColumn("text_hash", F.unhex(F.md5("text"))).drop("text"), "store"), whole.select("text_id", "text")
    want = sorted(map(str, A.answer_questions(asked, whole, templates, embed, search=R.knn).collect()))
    assert len(want) == 63 and any("same words" in w for w in want) and any(fv.NOTHING_FOUND in w for w in want)
    for most in (V.QUERY_LIMIT, 7):  # held by every task at once; in blocks
        search = lambda *a, **b: R.knn_stored(*a, query_limit=most, **b)
        answers = A.answer_questions(asked, apart, templates, embed, search=search, texts=texts)
        assert sorted(map(str, answers.collect())) == want


def test_many_queries_shuffle_no_vector_of_a_store(spark):
    rows = spark.range(3000).select(F.col("id").alias("chunk_id"), F.array(*[F.sin(F.col("id") * i).cast("float") for i in (1, 2, 3)]).alias("embedding"), (F.col("id") % 4).cast("string").alias("kind"))
    store = keep(rows.repartition(6), "vectors")
    queries = rows.limit(300).select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query_embedding"), F.when(F.col("chunk_id") % 3 == 0, F.col("kind")).alias("want"))
    options = {"k": 4, "per_query": {"kind": "want"}, "query_limit": 50}
    got, want = (search(queries, store, **options) for search in (R.knn_stored, R.knn))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 1200
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (got, want)]
    assert "CoGroup" in plans[1] and "CoGroup" not in plans[0]
    blocks = V.nearest(queries.withColumnRenamed("want", "kind"), store, 4, "question_id", "chunk_id", "query_embedding", "embedding",
                             ["kind"], query_limit=50, cell_vectors=64, stored=True)
    assert blocks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 5
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got.collect()))


def test_a_search_skips_blocks_without_the_term(spark):
    docs = spark.range(400).select(F.concat(F.lit("lib/d"), F.col("id").cast("string"), F.lit(".md")).alias("doc_path"), F.when(
        F.col("id") == 123, "Über the Zebra crossing").when(F.col("id") == 7, None).otherwise(F.concat(F.lit("plain words "), F.col("id").cast("string"))).alias("text"))
    path = shared_folder(spark, "search")
    SS.write_search_store(docs, path, block_rows=20)
    assert len(SS.candidate_blocks(spark, path, "zebra")) == 1 and len(SS.candidate_blocks(spark, path, "PLAIN words")) == 20
    assert SS.candidate_blocks(spark, path, "zq") is None and SS.candidate_blocks(spark, path, "zebras") == []
    for term in ("zebra", "ÜBER", "words 39", "d12", "zebras", ""):
        want = sorted(r["doc_path"] for r in docs.collect() if term.lower() in r["doc_path"].rsplit("/", 1)[1] or term.lower() in (r["text"] or "").lower())
        got, after = [], None
        while page := [r["doc_path"] for r in SS.search_store(spark, path, term, after, 150).collect()]:
            got, after = got + page, page[-1]
        assert got == want
    plan = SS.search_store(spark, path, "zebra")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+ = \d+", plan)


def test_a_long_text_is_signed_without_a_gap(monkeypatch):
    data = bytes(range(256)) * 3
    whole = set(SS._bits(data).tolist())
    monkeypatch.setattr(SS, "PIECE_BYTES", 7)
    assert {int(x) for piece in SS._pieces(data) for x in SS._bits(piece)} == whole and SS._bits(b"ab").tolist() == []
