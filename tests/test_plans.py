"""Skew-proof building blocks against brute force, and the shape of hot plans."""

import random

import numpy as np
from pyspark.sql import Window, functions as F
import pytest

from corpusq.functions import scoring as SC
from corpusq.functions.extensions import unit_cuts
from corpusq.operators import chunks as C, labelling as L, retrieval as R
from corpusq.plans import automaton, bounded, containment, nesting, ordered, vectors
from corpusq.plans.once import compute_once


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds a third of the rows; positions have gaps."""
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else i % 17 + 1, i * 2 + rng.randint(0, 1), rng.randint(-3, 5) if rng.random() > 0.2 else None) for i in range(900)]
    return spark.createDataFrame(rows, "g int, pos int, v int").cache()


def test_neighbours(hot):
    got = ordered.neighbours(hot, ["g"], "pos", ["pos", "v"], width=50)
    w = Window.partitionBy("g").orderBy("pos")
    want = hot.select("g", "pos", "v", F.lag("pos").over(w).alias("prev_pos"), F.lag("v").over(w).alias("prev_v"),
                      F.lead("pos").over(w).alias("next_pos"), F.lead("v").over(w).alias("next_v")).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 900


def test_missing_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 200, 6), ("a", 3, 7)], "g string, pos int, v int")
    got = {(r["g"], r["pos"]): (r["prev_v"], r["next_v"]) for r in ordered.neighbours(df, ["g"], "pos", ["v"], width=50).collect()}
    assert got == {(None, 1): (None, 6), (None, 200): (5, None), ("a", 3): (None, None)}
    assert ordered.running_sum(df, ["g"], "pos", "v", "s", width=50).filter("g IS NULL AND s = 11").count() == 1


def test_running_sum_and_last_value(hot):
    w = Window.partitionBy("g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = hot.fillna(0, ["v"])
    got = ordered.running_sum(filled, ["g"], "pos", "v", "s", width=40)
    assert got.exceptAll(filled.withColumn("s", F.sum("v").over(w))).count() == 0
    got = ordered.last_value(hot, ["g"], "pos", {"seen": F.when(F.col("v") > 2, F.col("v"))}, width=40)
    want = hot.withColumn("seen", F.last(F.when(F.col("v") > 2, F.col("v")), ignorenulls=True).over(w))
    assert got.exceptAll(want).count() == 0


def test_nest_splits_only_large_groups(hot):
    got = nesting.nest(hot, ["g"], "pos", F.struct("pos", "v"), "items", limit=100)
    parts = {r["g"]: (r["n"], r["m"]) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("items")).alias("m")).collect()}
    assert parts[0][0] > 1 and all(n == 1 for g, (n, _) in parts.items() if g) and max(m for _, m in parts.values()) <= 100
    assert got.select("g", F.explode("items").alias("i")).select("g", "i.pos", "i.v").exceptAll(hot).count() == 0
    assert got.select(F.sum(F.size("items"))).first()[0] == 900


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join(hot, how):
    small = hot.groupBy("g").agg(F.sum("v").alias("total")).filter("g % 2 = 0")
    assert nesting.salted_join(hot, small, ["g"], "pos", how).exceptAll(hot.join(small, "g", how)).count() == 0
    assert nesting.salted_join(hot, small, ["g"], "pos", how).count() == hot.join(small, "g", how).count()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_repeats_hot_keys_only(spark, hot, how):
    rows = hot.withColumn("g", F.when(F.col("pos") % 5 > 0, F.col("g")))
    small = hot.groupBy("g").agg(F.sum("v").alias("total")).filter("g % 2 = 0")
    got, want = nesting.salted_join(rows, small, ["g"], "pos", how, hot_rows=100), rows.join(small, "g", how)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    # a side that looks small to the planner is not broadcast, only the list of hot keys is
    assert "SortMergeJoin" in plan(got) and plan(nesting.salted_join(spark.range(90), spark.range(90), ["id"], "id", how)).count("Generate") <= 2


@pytest.mark.parametrize("held", [containment.HELD_TERMS, 0])
def test_contains_join(spark, held):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abC ") for _ in range(rng.randint(0, 14)))) for i in range(200)]
    terms = [(i, "".join(rng.choice("aBc") for _ in range(rng.randint(1, 5)))) for i in range(40)] + [(99, "zzzz"), (98, "")]
    t, k = spark.createDataFrame(texts, "tid int, body string"), spark.createDataFrame(terms, "kid int, word string")
    got = {(r["tid"], r["kid"]) for r in containment.contains_join(t, "body", k, "word", held_terms=held).collect()}
    assert got == {(i, j) for i, body in texts for j, word in terms if word and word.lower() in body.lower()}
    left = containment.contains_join(t, "body", k, "word", how="left_terms", held_terms=held)
    assert {r["kid"] for r in left.filter("tid IS NULL").collect()} >= {98, 99}


@pytest.mark.parametrize("held", [containment.HELD_TERMS, 0])
def test_contains_join_nulls_copies_and_long_texts(spark, held):
    long = "é😀 " * 40000 + "Needle"
    texts = [(1, "x", long), (2, "y", long), (3, "x", None), (4, "x", ""), (5, "x", "a😀b")]
    terms = [(1, "x", "NEEDLE"), (2, "x", "😀b"), (3, "x", None), (4, "x", ""), (5, "y", "needle"), (6, "x", "é"), (7, "x", "needles")]
    t = spark.createDataFrame(texts, "tid int, g string, body string")
    k = spark.createDataFrame(terms, "kid int, g string, word string")
    got = sorted((r["tid"], r["kid"]) for r in containment.contains_join(t, "body", k, "word", on=["g"], held_terms=held).collect())
    assert got == [(1, 1), (1, 6), (2, 5), (5, 2)]


def test_contains_join_explodes_no_text(spark):
    t, k = spark.createDataFrame([(1, "abc")], "tid int, body string"), spark.createDataFrame([(1, "b")], "kid int, word string")
    plan = containment.contains_join(t, "body", k, "word", held_terms=0)._jdf.queryExecution().optimizedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate explode" in line]
    assert generates and all("_text" not in line.split("false, [")[-1] for line in generates)


def test_held_terms_shuffle_no_text(spark):
    t, k = spark.range(100).select("id", F.col("id").cast("string").alias("body")), spark.createDataFrame([("7",)], "word string")
    found = containment.held_pairs(t, "body", k, "word")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange hashpartitioning" not in plan and found.count() == 19
    with pytest.raises(bounded.TooLarge):
        containment.held_pairs(t, "body", t.select(F.col("body").alias("word")), "word", limit=99)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_finds_what_contains_finds(seed):
    rng = random.Random(seed)
    terms = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(60)} | {"b" * 1500})
    texts = ["".join(rng.choices("abcdé ", k=rng.choice([0, 1, 6, 60, 4000]))) for _ in range(25)] + ["ab" * 900 + "b" * 1500, "x" * 5000, terms[0]]
    want = {(i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in t}
    for table_bytes in (1 << 20, 900):
        automata = automaton.build(terms, table_bytes, 1000)
        found = [a.found([t.encode() for t in texts]) for a in automata]
        assert {(i, j) for text, term in found for i, j in zip(text.tolist(), term.tolist())} == want
    assert len(automata) > 5
    with pytest.raises(bounded.TooLarge):
        automaton.build(terms, 900, 2)


def test_floored_sum(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in (0, 1, None):
        depth = 0
        for pos in range(0, 400, 2):
            step = rng.choice([-1, -1, 0, 1, 1]) if g != 1 else rng.choice([-1, -1, -1, 1])
            depth = max(0, depth + step)
            rows.append((g, pos, step))
            want[g, pos] = depth
    df = spark.createDataFrame(rows, "g int, pos long, v int")
    for width in (1, 7, 1000):
        assert {(r["g"], r["pos"]): r["d"] for r in ordered.floored_sum(df, ["g"], "pos", "v", "d", width).collect()} == want


@pytest.mark.parametrize("size,overlap", [(10, 3), (5, 0), (1, 1), (50, 49)])
def test_unit_cuts_against_a_fold(size, overlap):
    rng = random.Random(size)
    for _ in range(40):
        tokens = [rng.randint(1, 12) for _ in range(rng.randint(0, 60))]
        want, cur = [], []
        for i, t in enumerate(tokens):
            if cur and sum(tokens[j] for j in cur) + t > size:
                want.append((cur[0], cur[-1] + 1))
                tail = 0
                while tail < len(cur) and sum(tokens[j] for j in cur[len(cur) - tail - 1:]) <= overlap:
                    tail += 1
                cur = cur[len(cur) - tail:]
            cur.append(i)
        if cur:
            want.append((cur[0], cur[-1] + 1))
        assert unit_cuts(np.array(tokens, dtype=np.int64), size, overlap) == want


def test_small_rows(spark):
    assert len(bounded.small_rows(spark.range(5), 5)) == 5
    with pytest.raises(bounded.TooLarge):
        bounded.small_rows(spark.range(6), 5)


def test_knn_zero_vectors_ties_and_grid(spark):
    vecs = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [-1.0, 0.0])]
    chunks = spark.createDataFrame([(i, v, i % 2) for i, v in vecs], "chunk_id int, embedding array<float>, odd int")
    asked = spark.createDataFrame([(10, [1.0, 0.0], 1), (11, [0.0, 3.0], None)], "question_id int, query_embedding array<float>, want int")
    rows = R.knn(asked, chunks, 5).orderBy("question_id", "rank").collect()
    assert [r["chunk_id"] for r in rows if r["question_id"] == 10] == [1, 2, 3, 5, 4]
    assert rows[4]["distance"] is None
    grid = R.knn(asked, chunks, 5, query_limit=1)
    assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, rows))
    kept = R.knn(asked, chunks, 5, per_query={"odd": "want"}).filter("question_id = 10")
    assert {r["chunk_id"] for r in kept.collect()} == {1, 3, 5}


def test_knn_leaves_out_null_and_empty_vectors(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 1.0], 1)], "chunk_id int, embedding array<float>, odd int")
    asked = spark.createDataFrame([(10, None), (11, [0.0, 3.0]), (12, []), (13, [2.0, 0.0])], "question_id int, query_embedding array<float>")
    want = [(11, 1, 2), (11, 4, 1), (13, 1, 1), (13, 4, 2)]
    for limit in (100, 1):
        got = R.knn(asked, chunks, 5, query_limit=limit).select("question_id", "chunk_id", "rank").collect()
        assert sorted(map(tuple, got)) == want


def test_knn_keeps_only_k_rows_per_task(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_embedding"))
    text = plan(R.knn(q, e.withColumnRenamed("vec_id", "chunk_id"), 3, where={"label": 3}))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "EqualTo(label,3)" in text


def test_scoring_is_one_narrow_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(L.lexicon_score(docs, [("a", "the", 0.5), ("b", "and", 1.0)], "doc_id"))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_chunking_is_narrow_and_cleans_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_path"), "text")
    text = plan(C.chunk_documents(C.clean_documents(docs), size=50, overlap=5))
    assert "Exchange" not in text and "Python" not in text


def test_compute_once_is_not_copied(spark):
    df = compute_once(spark.createDataFrame([("a",)], "t string"), "u", F.regexp_replace("t", "a", "b")).filter("u <> ''").select("u", F.length("u"))
    lines = [l for l in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "regexp_replace" in l]
    assert len(lines) == 1


def test_siblings_gather_a_bounded_head(spark):
    rows = [("d", "s", i, f"c{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_path string, section_index string, chunk_pos int, chunk_id string")
    linked = C.link_siblings(df, k=5)
    got = {r["chunk_id"]: r["section_chunk_ids"] for r in linked.collect()}
    assert got["c2"] == ["c0", "c1", "c3", "c4", "c5"] and got["c40"] == ["c0", "c1", "c2", "c3", "c4"]
    assert "WindowGroupLimit" in plan(linked)


def test_the_grid_depends_on_bytes_not_on_the_query_limit(spark):
    queries, vecs = vectors.grid_blocks(300_000, 300_000, 64, 12)
    assert (queries + vecs) * 300_000 * 64 * 4 < 2e9  # bytes repeated for the cells; a block of 100 queries each made 115 GB
    assert vectors.grid_blocks(1, 3, 64, 12) == (1, 1)
    many = spark.range(400).select(F.col("id").alias("question_id"), F.array(F.col("id") % 7, F.lit(1), F.col("id") % 5).cast("array<float>").alias("query_embedding"))
    chunks = many.withColumnsRenamed({"question_id": "chunk_id", "query_embedding": "embedding"})
    held = R.knn(many, chunks, 4).collect()
    assert sorted(map(tuple, held)) == sorted(map(tuple, R.knn(many, chunks, 4, query_limit=2).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_rough_search_finds_the_exact_neighbours(seed):
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(seed)
    held = rng.normal(size=(700, 9)).astype(np.float32).astype(np.float64)
    held[rng.integers(0, 700, 200)] = held[3]  # copies tie, and ids decide
    held[300:] = held[300:] * 1e-4 + held[5]  # nearer to each other than single precision can tell
    held[10:14] = 0
    asked = held[::9]
    kind = [None if i % 50 == 0 else i % 3 for i in range(700)]
    wanted = [{"c": None if i % 4 == 0 else i % 3} for i in range(len(asked))]
    with np.errstate(invalid="ignore", divide="ignore"):
        far = np.round(1 - np.einsum("ik,jk->ij", vectors._unit(asked), vectors._unit(held)), 12)
    search = vectors._Search(asked, wanted, ["c"], [], 6)
    for low in range(0, 700, 100):
        search.add(np.arange(low, low + 100), held[low:low + 100], {"c": pa.array(kind[low:low + 100])})
    search.merge()
    rows, near, ids = search.best
    for q in range(len(asked)):
        allowed = [j for j in range(700) if wanted[q]["c"] is None or wanted[q]["c"] == kind[j]]
        order = sorted(allowed, key=lambda j: (vectors.UNDEFINED if np.isnan(far[q, j]) else far[q, j], j))[:6]
        assert ids[rows == q].tolist() == order


def test_unfiltered_counts_rank_nothing(spark):
    chunks = spark.createDataFrame([(1, [1.0]), (2, None), (3, []), (4, [0.0])], "chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([(10, [1.0]), (11, None), (12, [0.0]), (13, [2.0])], "question_id int, query_embedding array<float>")
    found = spark.createDataFrame([(13,)], "question_id int")
    for k, most in ((5, 2), (1, 1)):
        counts = R.unfiltered_counts(asked, found, chunks, k)
        assert sorted(map(tuple, counts.collect())) == [(10, most), (11, 0), (12, most)]
        assert "WindowGroupLimit" not in plan(counts) and "InArrow" not in plan(counts)


@pytest.mark.parametrize("seed", range(4))
def test_prefixes_find_what_contains_finds(seed, monkeypatch):
    from corpusq.plans import prefixes
    monkeypatch.setattr(prefixes, "PAIRS", 50)
    rng = random.Random(seed)
    terms = sorted({"".join(rng.choices("abé", k=rng.randint(1, 30))) for _ in range(200)} | {"b" * 1500, "a" * 9, "a" * 8, "a" * 17})
    texts = ["".join(rng.choices("abcé ", k=rng.choice([0, 1, 6, 60, 4000]))) for _ in range(25)] + ["ab" * 900 + "b" * 1500, "a" * 40, terms[0], *terms[::7]]
    text, term = prefixes.PrefixIndex([t.encode() for t in terms]).found([t.encode() for t in texts])
    assert list(zip(text.tolist(), term.tolist())) == [(i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in t]


def test_a_long_list_explodes_no_grams(spark):
    t = spark.range(300).select("id", F.concat(F.lit("Some word-"), F.col("id").cast("string")).alias("body"))
    k = spark.range(3000).select(F.col("id").alias("kid"), F.concat(F.lit("WORD-"), F.col("id").cast("string")).alias("word"))
    found = containment.contains_join(t, "body", k, "word", held_terms=5)
    assert "_gram" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["id"], r["kid"]) for r in found.collect()}
    assert got == {(i, j) for i in range(300) for j in range(300) if str(i).startswith(str(j))}
    sliced = containment.sliced_pairs(t, "body", k, "word", slice_terms=400)
    assert sliced.count() == len(got)
    with pytest.raises(bounded.TooLarge):
        containment.sliced_pairs(t, "body", k, "word", slice_terms=100)


def test_a_search_joins_small_chunks_and_ranks_what_is_asked(spark):
    from corpusq.operators import answering as A, vector_index as VI
    assert VI._joined_chunks(2160, 36) == 833  # 36 chunks of 60 rows are searched as one: a query is sent once
    assert VI._joined_chunks(10 * VI.CHUNK_ROWS, 10) == 1 and VI._joined_chunks(0, 1) >= 1
    limits = spark.createDataFrame([("a", 2), ("b", 6)], "question_id string, _n int")
    assert A.most_asked(limits) == 6 and A.most_asked(limits.withColumn("_n", F.lit(900))) == A.MOST_RESULTS
    assert A.most_asked(limits.filter("false")) == 1
