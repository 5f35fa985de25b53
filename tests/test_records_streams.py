"""Registry, libraries, records and streams on hand-written rows."""

import datetime
import random
import time

from pyspark.sql import functions as F
import pytest

from corpusq.checks import registry
from corpusq.checks.compare import TABLES, compare, oracle_connection
from corpusq.functions import extensions as U, fixed_values as fv
from corpusq.operators import entities as E, labelling as L, libraries as Lib, records as D
from corpusq.operators.context import reasoning_tokens, render_prompts, split_reasoning
from corpusq.operators.headings import assemble_section_text, toc_hierarchy
from corpusq.plans.scratch import shared_folder
from corpusq.sources import exports as X, markdown as MD
from corpusq.streaming import jobs as J
from corpusq.streaming.store import PathStore

SPELLS = """FIREBALL (INDIRECT)

**Type:** P ; **Range:** LOS (A) ; **Damage:** P ; **Duration:** I ; **Drain:** F - 1

Burns things.

MANABOLT
**Type:** M ; **Range:** LOS ; **Duration:** I ; **Drain:** F – 3

It hurts.
"""


def test_spell_records_with_and_without_damage(spark):
    df = spark.createDataFrame([("c1", "s", SPELLS)], "chunk_id string, source string, text string")
    got = [tuple(r)[3:] for r in E.extract_entities(df, types=("spell",))["spell"].orderBy("pos").collect()]
    assert got == [("Fireball", "P", "LOS (A)", "P", "I", "F - 1", "Combat", "Burns things."),
                   ("Manabolt", "M", "LOS", "", "I", "F – 3", "Combat", "It hurts.")]


def test_records_follow_every_name_that_occurs(spark):
    names = fv.SPELL_NAMES[:8]
    text = "\n\n".join(f"{n}\n**Type:** P ; **Range:** LOS ; **Duration:** I ; **Drain:** F - 2" for n in names)
    found = E.extract_spells(spark.createDataFrame([("c", "s", text)], "chunk_id string, source string, text string"))
    assert {r["name"].lower() for r in found.collect()} >= {n.lower() for n in names}


def test_table_of_contents_of_any_depth(spark):
    toc = spark.createDataFrame([("d", i, i + 1, f"t{i}") for i in range(9)], "doc string, seq int, level int, title string")
    got = {r["seq"]: (r["parent"], r["section"]) for r in toc_hierarchy(toc).collect()}
    assert got == {i: (f"t{i - 1}" if i else None, "t0") for i in range(9)}


def test_prompt_of_a_question_without_context(spark):
    asked = spark.createDataFrame([(1, "q", "x", None, None, None, None)], "question_id int, question string, query_type string, character_role string, character_stats string, edition string, conversation_context string")
    templates = spark.createDataFrame([("general", "{context}|{question}")], "query_type string, template string")
    none = spark.createDataFrame([], "question_id int, context string")
    assert [r["prompt"] for r in render_prompts(asked, none, templates).collect()] == [fv.NOTHING_FOUND + "|q"]


def test_registry_last_write_wins(spark):
    old = spark.createDataFrame([("a", "s", 1, "x"), ("b", "s", 2, "y")], "name string, source string, seq int, v string")
    new = spark.createDataFrame([("a", "s", 5, "z"), ("a", "t", 4, "w")], old.schema)
    assert sorted(map(tuple, E.registry_upsert(old, new).collect())) == [("a", "s", 5, "z"), ("a", "t", 4, "w"), ("b", "s", 2, "y")]


def test_quality_type_reaches_later_matches_of_the_line(spark):
    text = "# Flaws\n| Bad Luck | 12 | Positive | | Ugly Face | 5 |  |\n- Gremlins [5]"
    df = spark.createDataFrame([("d", text)], "doc_path string, text string")
    got = {r["name"]: (r["quality_type"], r["karma_cost"]) for r in Lib.extract_qualities(df).collect()}
    assert got == {"Bad Luck": ("positive", 12), "Ugly Face": ("positive", 5), "Gremlins": ("negative", 5)}


@pytest.mark.parametrize("text,section,confidence", [
    ("nothing", "Setting", 0.3), ("ares and pistol", "Gear", 0.35), ("colt", "Setting", 0.3), ("fireball", "Magic", 0.3),
    ("black ic, biofeedback, ares, colt", "Gear", 0.4)])
def test_pattern_labels(spark, text, section, confidence):
    row = L.classify_by_patterns(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["primary_section"], round(row["confidence"], 3)) == (section, confidence)


def test_label_and_correct(spark):
    def model(text):
        return '{"primary_section": "Social", "content_type": "narrative", "contains_rules": true}' if "ok" in text else "no json"
    df = spark.createDataFrame([(1, "ok fireball and manabolt"), (2, "ok talk"), (3, "fireball")], "id int, text string")
    got = {r["id"]: (r["primary_section"], r["classification_method"]) for r in U.label_and_correct(df, U.register_labeller(model)).collect()}
    assert got == {1: ("Magic", "llm_semantic"), 2: ("Social", "llm_semantic"), 3: ("Magic", "pattern_fallback")}


def test_change_replay_corner_cases(spark):
    base = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "key int, n int, t string")
    log = spark.createDataFrame([
        (1, 1, "update", None, "a2"), (1, 2, "insert", 99, "no"), (2, 1, "delete", None, None), (2, 2, "update", 5, "no"),
        (3, 1, "update", 1, "no"), (3, 2, "insert_or_ignore", 3, "c"), (3, 3, "update", 4, None), (4, 1, "insert", 1, "d"),
        (4, 2, "insert_or_replace", 2, None), (5, 1, "insert", 1, "e"), (5, 2, "delete", None, None), (5, 3, "insert", 2, "e2")],
        "key int, seq int, op string, n int, t string")
    got = {r["key"]: (r["n"], r["t"], r["touched_seq"]) for r in D.apply_changes(base, log, "key", ["n", "t"]).collect()}
    assert got == {1: (10, "a2", 1), 3: (4, "c", 3), 4: (2, None, 2), 5: (2, "e2", 3)}


@pytest.mark.parametrize("width", [1, 3, 10 ** 6])
def test_change_replay_against_a_fold(spark, width):
    rng = random.Random(8)
    base = [(k, k * 10, f"b{k}") for k in range(0, 40, 2)]
    ops = ["insert", "insert_or_ignore", "insert_or_replace", "update", "update", "update", "delete"]
    log = [(0 if rng.random() < 0.3 else rng.randrange(45), seq, rng.choice(ops), rng.choice([None, rng.randrange(99)]), rng.choice([None, f"t{seq}"]))
           for seq in range(600)]
    state = {k: (n, t, None) for k, n, t in base}
    for k, seq, op, n, t in log:
        if op == "delete":
            state.pop(k, None)
        elif op == "insert_or_replace" or (op != "update" and k not in state):
            state[k] = (n, t, seq)
        elif op == "update" and k in state:
            state[k] = (state[k][0] if n is None else n, state[k][1] if t is None else t, seq)
    got = D.apply_changes(spark.createDataFrame(base, "key int, n int, t string"), spark.createDataFrame(
        log, "key int, seq int, op string, n int, t string"), "key", ["n", "t"], width=width)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and plan.count("Scan ExistingRDD") == 2
    assert {r["key"]: (r["n"], r["t"], r["touched_seq"]) for r in got.collect()} == state


def test_csv_cells_are_quoted(spark):
    row = spark.createDataFrame([('a, "b"',)], "x string").select(X._csv(F.col("x"), F.lit(3), F.lit(None).cast("string")).alias("l")).first()
    assert row["l"] == '"a, ""b""",3,'


def test_markdown_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("book.pdf", 7, "Matrix: Basics", "body\ntext")], "source string, section_number int, title string, content string")
    file = MD.write_front_matter(rows).first()
    assert file["file_name"] == "book-07-Matrix_Basics.md"
    folder = tmp_path / "deep"
    folder.mkdir()
    (folder / file["file_name"]).write_text(file["text"], encoding="utf8")
    (folder / "skip.txt").write_text("x")
    parsed = MD.parse_front_matter(MD.scan_markdown(spark, str(tmp_path))).collect()
    assert len(parsed) == 1 and parsed[0]["meta"]["primary_section"] == "Matrix" and parsed[0]["meta"]["section_number"] == "7"
    assert parsed[0]["body"] == "# Matrix: Basics\n\nbody\ntext"


def events(spark, rows):
    return spark.createDataFrame(rows, "doc_path string, text string, op string, seq bigint")


def state(spark, store):
    return {r["doc_path"]: r["text"] for r in J.current_chunks(spark, store).collect()}


def test_ingest_is_idempotent_and_ignores_late_events(spark):
    store = shared_folder(spark, "test")
    first = events(spark, [("a", "One.", "upsert", 1), ("b", "Two.", "upsert", 2), ("c", "", "remove", 9)])
    J.ingest_batch(first, 0, store)
    J.ingest_batch(first, 0, store)
    assert state(spark, store) == {"a": "One.", "b": "Two."}
    J.ingest_batch(events(spark, [("a", "Newer.", "upsert", 5), ("b", "Two.", "upsert", 6), ("c", "Late.", "upsert", 3)]), 1, store)
    assert state(spark, store) == {"a": "Newer.", "b": "Two."}
    kept = PathStore(spark, store).read("versions").filter("doc_path = 'b'").orderBy("seq").collect()
    assert [r["chunk_batch"] for r in kept] == [0, 0]
    J.ingest_batch(events(spark, [("a", "Old.", "upsert", 4), ("b", "", "remove", 7)]), 2, store)
    assert state(spark, store) == {"a": "Newer."}


def test_job_status_clamps_and_expires(spark):
    rows = [("j1", "parse", -1.0, "", 0, 1), ("j2", "complete", 100.0, "", 0, 2), ("j3", "complete", 250.0, "", 400, 3)]
    df = spark.createDataFrame(rows, "job_id string, stage string, progress double, details string, t int, seq bigint").withColumn(
        "ts", F.timestamp_seconds("t"))
    assert {r["job_id"]: r["progress"] for r in J.job_status(df).collect()} == {"j1": 0.0, "j2": 100.0, "j3": 100.0}
    assert {r["job_id"] for r in J.job_status(df, F.timestamp_seconds(F.lit(500))).collect()} == {"j1", "j3"}


def test_entity_counts_stay_in_the_row(spark):
    df = spark.createDataFrame([(1, "s", None, True), (2, "s", "", None)], "chunk_id int, source string, text string, has_entities boolean")
    counted = E.entity_counts(df)
    assert [tuple(r)[3:] for r in counted.orderBy("chunk_id").collect()] == [(0, 0, 0, False)] * 2
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert all(rows.count() == 0 for rows in E.extract_entities(df).values())
    assert E.reextract(df)[1].count() == 1


@pytest.fixture(scope="module")
def hot_parent(sf, tmp_path_factory):
    """The smallest tables, in which one customer has 24,000 more orders with sparse keys."""
    import duckdb
    folder, con = tmp_path_factory.mktemp("hot"), duckdb.connect()
    for table in TABLES:
        if table not in ("orders", "lineitem"):
            (folder / f"{table}.parquet").symlink_to(f"{sf}/{table}.parquet")
    n = con.execute(f"SELECT count(*) FROM '{sf}/orders.parquet'").fetchone()[0]
    many = f"(SELECT unnest(range(1, {24000 // n + 2})) AS i)"
    con.execute(f"""COPY (SELECT * FROM '{sf}/orders.parquet' UNION ALL SELECT * EXCLUDE (i) REPLACE (o_orderkey + i * 1000000 AS o_orderkey, (SELECT min(c_custkey) FROM '{sf}/customer.parquet') AS o_custkey)
     FROM '{sf}/orders.parquet', {many}) TO '{folder}/orders.parquet'""")
    con.execute(f"""COPY (SELECT * FROM '{sf}/lineitem.parquet' UNION ALL SELECT * EXCLUDE (i) REPLACE (l_orderkey + i * 1000000 AS l_orderkey)
     FROM '{sf}/lineitem.parquet', {many} WHERE l_linenumber = 1) TO '{folder}/lineitem.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["entity_summary", "full_record", "export_json"])
def test_a_parent_of_many_children_is_one_row(spark, hot_parent, name):
    status, detail, _, _ = compare(spark, oracle_connection(hot_parent), hot_parent, registry.queries()[name], registry.oracle_sql()[name])
    assert status == "ok", detail[:500]


def test_long_form_holds_the_items_of_the_nested_form(spark, sf):
    from corpusq.checks import recording as Q
    stats, skills = Q.stats(spark, sf), Q.skills(spark, sf)
    rows = D.summary_skills(stats, skills).groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("i"))
    flat = rows.select("parent_id", F.transform("i", lambda x: x["item"]).alias("skills"))
    nested = D.entity_summary(Q.parents(spark, sf), stats, skills, Q.gear(spark, sf)).select("parent_id", "skills").filter("skills is not null")
    assert nested.count() and nested.exceptAll(flat).count() == 0
    children = {"gear": (Q.gear(spark, sf), "gear_id", ["category", "name"])}
    assert D.record_children(children)["gear"].count() == Q.gear(spark, sf).count()


def test_a_long_message_is_one_row(spark):
    words = ["<think>" if i % 50 == 7 else "</think>" if i % 50 == 31 else f"w{i} " for i in range(1000)]
    rows = [(c, i * 3, w) for c in (1, 2) for i, w in enumerate(words) if c == 1 or i < 5] + [(3, 250 * 100000, "far"), (3, 5, "near ")]
    tokens = spark.createDataFrame(rows, "conv_id bigint, seq bigint, token string")
    want = {False: "".join(w for i, w in enumerate(words) if w[0] == "w" and not 7 < i % 50 < 31),
            True: "".join(w for i, w in enumerate(words) if w[0] == "w" and 7 < i % 50 < 31)}
    for part in (100, 100000):
        got = {r["conv_id"]: (r["part"], r["thinking"], r["answer"]) for r in split_reasoning(tokens, part=part).collect()}
        assert got == {1: (0, want[True], want[False]), 2: (0, "", "".join(words[:5])), 3: (0, "", "near far")}
        assert split_reasoning(tokens, part=part).count() == 3
    assert reasoning_tokens(tokens).count() == len([r for r in rows if "think>" not in r[2]])


def test_a_long_section_is_one_row(spark):
    pages = spark.createDataFrame([("d", i, " " if i % 10 == 0 else f"p{i}") for i in range(100)], "doc string, page int, text string")
    ranges = spark.createDataFrame([("d", 0, "all", 0, 99), ("d", 1, "two", 5, 6)], "doc string, seq int, title string, start_page int, end_page int")
    got = {r["title"]: (r["part"], r["text"]) for r in assemble_section_text(pages, ranges, pages_per_part=7).collect()}
    assert got == {"all": (0, "\n\n".join(f"p{i}" for i in range(100) if i % 10)), "two": (0, "p5\n\np6")}
    assert assemble_section_text(pages, ranges, pages_per_part=7).count() == 2


def test_streamed_texts_get_the_chunks_of_the_batch_path(spark, sf, monkeypatch):
    query, sql = registry.queries()["stream_ingest_texts"], registry.oracle_sql()["stream_ingest_texts"]
    status, detail, _, rows = compare(spark, oracle_connection(sf), sf, query, sql)
    assert status == "ok" and rows > 100, detail[:500]
    # a stream that loses the end of each text is seen
    whole = J.ingest_batch
    monkeypatch.setattr(J, "ingest_batch", lambda docs, *a, **k: whole(docs.withColumn("text", F.left("text", F.lit(100))), *a, **k))
    assert compare(spark, oracle_connection(sf), sf, query, sql)[0] in ("VALUE", "COUNT")


def test_the_labeller_gets_the_whole_text(spark):
    def model(text):
        return '{"primary_section": "Social", "content_type": "narrative", "contains_rules": true}' if "ok" in text else "no json"
    df = spark.createDataFrame([(1, "talk " * 2000 + "ok")], "id int, text string")
    method = "classification_method"
    assert U.label_and_correct(df, U.register_labeller(model)).first()[method] == "llm_semantic"
    assert U.label_and_correct(df, U.register_labeller(model), cut=4000).first()[method] == "pattern_fallback"


def _token_batches(spark, tmp_path, batches):
    """One file per micro-batch of (conv_id, seq, token, is_last, second)."""
    folder = tmp_path / "tokens"
    schema = "conv_id long, seq long, token string, is_last boolean, ts timestamp"
    start = datetime.datetime(2024, 1, 1)
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(c, s, t, e, start + datetime.timedelta(seconds=x)) for c, s, t, e, x in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are taken in order of their time of change
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _split_rows(spark, stream, tmp_path):
    out, seen = str(tmp_path / "out"), []
    query = (stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint"))
             .foreachBatch(lambda df, i: seen.extend((r["conv_id"], r["out_seq"], r["inside"], r["text"]) for r in df.collect()))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return seen, rows


def test_reasoning_state_ends_with_the_last_token(spark, tmp_path):
    batches = [[(1, 0, "a</think>b<th", False, 0), (2, 0, "x<think>y", False, 0)], [(1, 1, "ink>c</think>d", True, 1)],
               [(2, 1, "</think>z", True, 2), (1, 2, "new <think>m", False, 3)]]
    rows, held = _split_rows(spark, J.stream_split_reasoning(_token_batches(spark, tmp_path, batches).drop("ts")), tmp_path)
    # a row after the last token starts a new message
    assert sorted(r for r in rows if r[0] == 2) == [(2, 0, False, "x"), (2, 1, True, "y"), (2, 2, False, "z")]
    assert [r[2:] for r in rows if r[0] == 1] == [(False, "a"), (False, "b"), (True, "c"), (False, "d"), (False, "new "), (True, "m")]
    assert held == [2, 1, 1]


def test_idle_reasoning_state_ends_by_event_time(spark, tmp_path):
    batches = [[(1, 0, "a<think>b<", False, 0), (2, 0, "x", False, 0)], [(2, 1, "y", False, 500)], [(2, 2, "z", False, 501)],
               [(1, 1, "late</think>", False, 1), (2, 3, "!", True, 502)]]
    stream = J.stream_split_reasoning(_token_batches(spark, tmp_path, batches), idle_seconds=100, lateness="10 seconds")
    rows, held = _split_rows(spark, stream, tmp_path)
    # the possible tag comes out when the conversation is given up; what arrives after that is too late
    assert [r[2:] for r in rows if r[0] == 1] == [(False, "a"), (True, "b"), (True, "<")]
    assert "".join(r[3] for r in rows if r[0] == 2) == "xyz!" and held[-1] == 0


def test_text_summary_of_balances_near_zero(spark, tmp_path):
    import duckdb
    from corpusq.checks import recording
    balances = [-0.0, -0.004, 0.0, 0.004, -0.01, 12.5, None]
    people = [(i + 1, f"Customer {i}", 1, b, "BUILDING") for i, b in enumerate(balances)]
    orders = [(1, 1, "F", 70000.0, "1-URGENT")]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for table in ("customer", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    con.execute("CREATE VIEW lineitem AS SELECT 1::BIGINT AS l_orderkey, 1 AS l_linenumber, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1.0::DOUBLE AS l_quantity, 'R' AS l_returnflag")
    want = sorted(con.execute(recording.checks.oracles["export_text_summary"]).fetchall())
    got = sorted(tuple(r) for r in recording.checks.queries["export_text_summary"](spark, str(tmp_path)).collect())
    assert got == want and "Essence: -0.0" in got[0][1]


def test_text_that_no_tag_cuts_is_one_row(spark, tmp_path):
    batches = [[(1, i, t, False, 0) for i, t in enumerate(["ab", "c<", "d", "<thi", "nk>", "e", "f"])], [(1, 9, "g</th", False, 1), (1, 10, "ink>h", True, 1)]]
    rows, _ = _split_rows(spark, J.stream_split_reasoning(_token_batches(spark, tmp_path, batches).drop("ts")), tmp_path)
    assert rows == [(1, 0, False, "abc<d"), (1, 1, True, "ef"), (1, 2, True, "g"), (1, 3, False, "h")]


def test_jobs_that_share_a_group_are_kept_and_dropped_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "BUNDLES", 1)
    schema = "job_id string, stage string, progress double, details string, ts timestamp, seq bigint"
    at = [datetime.datetime(2024, 1, 1, 0, 0, i) for i in range(3)]
    batches = [[("a", "complete", 101.0, "x", at[1], 1), ("a", "run", 5.0, None, at[0], 2), ("b", "run", -1.0, None, at[1], 1)],
               [("c", "run", 1.0, None, at[0], 1)], [("a", "run", 7.0, None, at[0], 3), ("b", "run", 7.0, None, at[0], 3)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    J.run_once(J.stream_job_status(stream, retention=1), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "update")
    out = [{(r["job_id"], r["stage"], r["progress"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/out/batch={i}").collect()} for i in range(3)]
    # the complete job is forgotten after a second, so its late report counts; that of the other one does not
    assert out == [{("a", "complete", 100.0, 1), ("b", "run", 0.0, 1)}, {("c", "run", 1.0, 1)}, {("a", "run", 7.0, 3), ("b", "run", 0.0, 1)}]


def test_stream_tables_are_dealt_over_all_cores(spark, tmp_path):
    from corpusq.checks import streams
    cores = spark.sparkContext.defaultParallelism
    stream = streams._as_stream(spark, spark.range(1000).select(F.col("id").alias("seq"), F.col("id").alias("key")), "dealt", "key")
    seen = []
    stream.writeStream.foreachBatch(lambda df, i: seen.append((df.select(F.input_file_name()).distinct().count(), df.count()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in seen] == [cores] * 4 and sum(n for _, n in seen) == 1000


def test_batches_of_long_texts_are_bounded_in_bytes(spark, tmp_path):
    from corpusq.plans.batches import BATCH_BYTES, MAX_BYTES
    spark.conf.unset(MAX_BYTES)
    label = U.register_labeller(lambda t: str(len(t)))
    assert spark.conf.get(MAX_BYTES) == str(BATCH_BYTES)
    texts = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("a"), F.lit(1 << 20)).alias("text"))

    @F.pandas_udf("long")
    def held(batch):
        import pandas as pd
        return pd.Series([batch.str.len().sum()] * len(batch))
    assert texts.agg(F.max(held("text"))).first()[0] <= 2 * BATCH_BYTES
    assert texts.filter(label("text") == str(1 << 20)).count() == 100
    spark.conf.set(MAX_BYTES, "1000")  # a limit that is set already wins
    U.register_labeller(lambda t: t)
    assert spark.conf.get(MAX_BYTES) == "1000"
    spark.conf.unset(MAX_BYTES)


def test_stream_ingest_texts_lists_the_documents_of_its_sql(spark, tmp_path):
    import duckdb
    import __spark_entry__ as entry
    texts = [(1, "É."), (2, "A word."), (3, ""), (4, "12"), (5, None), (6, "è"), (7, "Removed."), (8, "<b>"), (9, "One. Two.")]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "stream_ingest_texts"
    got = {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    # a text that cleaning empties is reported, not left out
    lost = ("lib/doc-8.md", True, 0)
    assert got == set(con.execute(entry.oracle_sql()[name]).fetchall()) - {lost} | {("lib/doc-8.md", False, 0)}
