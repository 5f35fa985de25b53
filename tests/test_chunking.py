"""Packing against plain reference folds, on hand-written and seeded random texts."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F
import pytest

from corpusq.functions.arrays import fold
from corpusq.functions.extensions import unit_cuts
from corpusq.functions.text import count_tokens, strip
from corpusq.operators import chunks as C, packing as P, sections as S

SPLIT = re.compile(r"(?<=[.!?])\s+")


def n(text):
    return len(text.split())


def reference_pack(blocks, size, overlap):
    out, cur, tokens = [], [], 0

    def flush(kind):
        text = "\n\n".join(c for _, c in cur)
        if text.strip():
            out.append((text, tokens, kind))

    def tail():
        for kind, content in reversed(cur):
            if kind == "text":
                kept, used = [], 0
                for s in reversed(SPLIT.split(content)):
                    if used + n(s) > overlap:
                        break
                    kept.insert(0, s)
                    used += n(s)
                return " ".join(kept)
        return ""
    for kind, content in blocks:
        if kind == "table":
            if cur and tokens + n(content) > size:
                flush("mixed")
                cur, tokens = [], 0
            if tokens + n(content) <= size:
                cur.append(("table", content))
                tokens += n(content)
            else:
                lines = content.split("\n")
                words = ("weapon", "acc", "damage", "name")
                head = [l for l in lines if "|" in l and any(w in l.lower() for w in words)]
                data = [l for l in lines if l not in head and ("|" in l or re.search(r"\d+[PS]|\d+¥", l))]
                for i in range(0, len(data), 10):
                    text = "\n".join(head + data[i:i + 10])
                    out.append((text, n(text), "table_split"))
            continue
        for s in SPLIT.split(content):
            if tokens + n(s) > size and cur:
                flush("text")
                seed = tail()
                cur, tokens = ([("text", seed)], n(seed)) if seed else ([], 0)
            if cur and cur[-1][0] == "text":
                cur[-1] = ("text", cur[-1][1] + " " + s)
            else:
                cur.append(("text", s))
            tokens += n(s)
    flush("text")
    return out


def random_blocks(rng):
    def sentence():
        return " ".join(rng.choice(["ab", "Cde", "f", "xyz"]) for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "?", ""])
    blocks, last = [], None
    for _ in range(rng.randint(1, 7)):
        if last != "table" and rng.random() < 0.4:
            rows = ["| Name | a |"] + [f"| r{i} | {i}P |" for i in range(rng.randint(1, 25))]
            blocks.append(("table", "\n".join(rows)))
            last = "table"
        elif last != "text":
            blocks.append(("text", " ".join(sentence() for _ in range(rng.randint(1, 12))).strip()))
            last = "text"
    return blocks


def test_pack_sentences_equals_reference_fold(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([6, 12, 30]), rng.choice([0, 3, 8]), random_blocks(rng)) for i in range(150)]
    for size, overlap in {(r[1], r[2]) for r in rows}:
        part = [r for r in rows if (r[1], r[2]) == (size, overlap)]
        df = spark.createDataFrame([(r[0], r[3]) for r in part], "id int, blocks array<struct<type:string,content:string>>")
        got = {r["id"]: [tuple(c) for c in r["c"]] for r in
               df.select("id", P.pack_sentences(F.col("blocks"), size, overlap).alias("c")).collect()}
        for r in part:
            assert got[r[0]] == reference_pack(r[3], size, overlap), r


def test_overlap_may_chain_and_may_be_empty(spark):
    df = spark.createDataFrame([([("text", "One two. Three four. Five six seven eight nine. Ten.")],)],
                               "blocks array<struct<type:string,content:string>>")
    texts = [c["text"] for c in df.select(P.pack_sentences(F.col("blocks"), 5, 2).alias("c")).first()["c"]]
    assert texts == ["One two. Three four.", "Three four. Five six seven eight nine.", "Ten."]


def test_header_sections_rules(spark):
    text = "pre\n# A\n\n## B\nbody\n#### not a header\n#x\n # C  \ntail"
    df = spark.createDataFrame([(1, text), (2, "# only"), (3, " \n")], "id int, text string")
    got = [(r["id"], r["section_index"], r["section_title"], r["section_level"], r["content"]) for r in S.split_by_headers(df).collect()]
    assert got == [(1, 0, "", 1, "pre\n"), (1, 1, "B", 2, "body\n#### not a header\n#x\n"), (1, 2, "C", 1, "tail\n"), (2, 0, "Content", 1, "# only")]


def test_stat_block_detection(spark):
    text = "intro\nAcc 5\n\n12 3\n7-8\nplain words\n| a | b |\n| c | d |\nmode 3\n# head"
    rows = [tuple(r) for r in S.detect_tables(spark.createDataFrame([(1, text)], "id int, text string")).collect()]
    assert rows == [(1, 1, 4, "weapon_stats")]


def test_pack_table_lines_rules(spark):
    text = "a b c\n\nd e f\n| h | i |\n| 1 | 2 |\nafter one\n" + "\n".join(f"line {i} x" for i in range(4))
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(P.pack_table_lines(F.col("t"), 8, 4)).alias("c")).select("c.*")
    got = [(r["text"], r["chunk_type"], r["table_header"]) for r in df.collect()]
    assert got[0] == ("a b c\n\nd e f", "paragraph", None)
    assert got[1] == ("| h | i |\n| 1 | 2 |", "table", None)
    assert all(kind == "paragraph" for _, kind, _ in got[2:])
    assert got[-1][0].endswith("line 3 x")


def test_final_table_keeps_its_header(spark):
    df = spark.createDataFrame([("x\n| h | i |\n| 1 | 2 |",)], "t string").select(F.explode(P.pack_table_lines(F.col("t"), 800)).alias("c")).select("c.*")
    assert [tuple(r) for r in df.collect()] == [("x\n| h | i |\n| 1 | 2 |", 11, "table", "| h | i |")]


def test_carried_units(spark):
    df = spark.createDataFrame([("a b\n\nc d\n\ne f g h",)], "t string")
    got = df.select(P.pack_paragraphs(F.col("t"), 5).alias("c")).first()["c"]
    assert [(c["text"], c["token_count"]) for c in got] == [("a b\n\nc d", 4), ("c d\n\ne f g h", 6)]
    got = spark.createDataFrame([("A b. C d. E f. G h i.",)], "t string").select(P.pack_sentences_tail(F.col("t"), 6).alias("c")).first()["c"]
    assert [(c["text"], c["token_count"]) for c in got] == [("A b. C d. E f.", 6), ("C d. E f. G h i.", 7)]


def test_row_links_equal_window_links(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.concat(F.lit("lib/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"),
        F.regexp_replace("text", r"(^|\n)([A-F])", "$1# $2").alias("text"))
    cols = ["chunk_id", "text", "token_count", "prev_chunk_global", "next_chunk_global", "prev_chunk_section", "next_chunk_section",
            "section_complete", "total_chunks_in_section", "section_id", "section_chunk_ids"]
    inside = C.chunk_documents(docs, size=40, overlap=8).select(*cols)

    def plain(texts):
        return F.transform(texts, count_tokens)
    windowed = C.chunk_documents(docs, size=40, overlap=8, tokens=plain).select(*cols)
    assert inside.exceptAll(windowed).count() == 0 and windowed.exceptAll(inside).count() == 0
    assert inside.count() > 500


def test_chunks_keep_budget_and_every_word(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_path"), "text").filter(strip("text") != "")
    chunks = C.chunk_documents(docs, size=50, overlap=0)
    words = docs.select("doc_path", count_tokens("text").alias("n"))
    packed = chunks.groupBy("doc_path").agg(F.sum("token_count").alias("m"))
    assert words.join(packed, "doc_path").filter("n <> m").count() == 0
    long = chunks.filter("token_count > 50").select(F.size(F.split("text", r"(?<=[.!?])\s+")).alias("s"))
    assert long.filter("s > 1").count() == 0


def plain_table_lines(content, size, least):
    """Brute force over one text, written from the packing rules."""
    out, buf, used, inside, header = [], [], 0, False, None

    def emit(lines, count, kind, head=None):
        text = "\n".join(lines).strip()
        if text:
            out.append((text, count, kind, head))
    for line in content.split("\n"):
        if "|" in line and not inside:
            if buf and used > least:
                emit(buf, used, "paragraph")
                buf, used = [], 0
            inside, header = True, line.strip()
            buf, used = buf + [line], used + n(line)
        elif inside and "|" not in line and line.strip():
            emit(buf, used, "table")
            inside, header, buf, used = False, None, [line], n(line)
        else:
            buf, used = buf + [line], used + n(line)
            if used > size and not inside:
                blank = [i for i in range(1, len(buf)) if not buf[i].strip() or not buf[i - 1].strip()]
                cut = max(blank) if blank else len(buf) // 2
                if cut:
                    emit(buf[:cut], n("\n".join(buf[:cut])), "paragraph")
                    buf = buf[max(0, cut - 2):]
                    used = n("\n".join(buf))
    if buf:
        emit(buf, used, "table" if inside else "paragraph", header)
    return out


def test_pack_table_lines_equals_brute_force(spark):
    rng = random.Random(11)
    kinds = ["| a | b |", "| 1 | 2 | x y |", "", "  ", "one two three.", "w", "four five six seven eight nine"]
    texts = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    df = spark.createDataFrame(texts, "id int, t string")
    for size, least in ((8, 3), (20, 10)):
        got = {r["id"]: [tuple(c) for c in r["c"]] for r in df.select("id", P.pack_table_lines(F.col("t"), size, least).alias("c")).collect()}
        for i, text in texts:
            assert got[i] == plain_table_lines(text, size, least), text


def test_dropped_table_lines_are_counted(spark):
    rows = [("a", "| Weapon | Damage |\n| Colt | 5P |\nsee page three\n\n| Uzi | 6P |"), ("b", "no data here\nat all\n"),
            ("c", "| Weapon | Damage |\nnothing"), ("d", ""), ("e", "| Colt | 5P |"), ("f", None)]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {r["k"]: (r["d"]["lines"], r["d"]["blocks"]) if r["d"]["lines"] is not None else None
           for r in df.select("k", P.split_table_drops(F.col("text"), ["weapon"]).alias("d")).collect()}
    assert {k: got[k] for k in "abcde"} == {"a": (1, 0), "b": (2, 1), "c": (2, 1), "d": (0, 0), "e": (0, 0)}
    chunks = {r["k"]: "\n".join(c["text"] for c in r["c"] or []) for r in df.select("k", P.split_large_table(F.col("text"), header_words=["weapon"]).alias("c")).collect()}
    for key, text in rows[:5]:
        lost = [l for l in text.split("\n") if l.strip() and l not in chunks[key].split("\n")]
        assert len(lost) == got[key][0]


@pytest.mark.parametrize("block", [1, 2, 5, 512])
def test_fold_equals_a_plain_aggregate(spark, block):
    """The sums of runs that end where a running sum passes ten."""
    rng = random.Random(block)
    rows = [([rng.randint(0, 6) for _ in range(n)],) for n in (0, 1, 2, 4, 5, 6, 10, 11, 40)] + [(None,)]
    none = F.array().cast("array<int>")

    def step(acc, x):
        full = acc["sum"] + x > 10
        return F.when(full, F.struct(x.alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))).otherwise(
            F.struct((acc["sum"] + x).alias("sum"), acc["out"].alias("out")))

    def finish(acc):
        return F.concat(acc["out"], F.array(acc["sum"]))
    zero = F.struct(F.lit(0).alias("sum"))
    df = spark.createDataFrame(rows, "xs array<int>")
    got = df.select(fold(F.col("xs"), zero, ["sum"], none, step, finish, block).alias("a"), F.aggregate(
        "xs", F.struct(F.lit(0).alias("sum"), none.alias("out")), step, finish).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and len(got) == 10


def test_a_very_long_document_is_packed_in_linear_time(spark):
    rng = random.Random(9)
    sentences = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(3, 25))) + "." for _ in range(40000)]
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("content")))

    def pack(part):
        df = spark.createDataFrame([(" ".join(part),)], "text string").coalesce(1)
        start = time.time()
        made = df.select(F.explode(P.pack_sentences(block, 100, 20)).alias("c")).select("c.text", "c.token_count").collect()
        return made, time.time() - start
    pack(sentences[:100])
    small, quick = pack(sentences[:10000])
    large, slow = pack(sentences)
    cuts = unit_cuts(np.array([len(s.split()) for s in sentences]), 100, 20)
    assert [r["text"] for r in large] == [" ".join(sentences[a:b]) for a, b in cuts]
    assert slow < 10 * quick + 5 and len(large) > 3.9 * len(small)
