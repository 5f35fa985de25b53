"""Fill-in-middle, fingerprints and centroids on small fixtures, beside brute-force versions."""

import functools
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import digest, fim, lookup

DOCS = "doc_id bigint, text string, lang string, N string, form string, fingerprint string, near_next int, part int, kind string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(11)
    words = ["alpha", "é", "x", "Straße", "<b>", "日本", "tail", "\n", "1.5"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 400, 40)]
    texts += ["", None, "a", "ab", "abc", "a<P>b", "w" * 70000, "long text " * 9000, "é" * 5000, texts[0], texts[0], "<S", "S>", "<", "<<P<M"]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(3, "one id"), (3, "two texts"), (3, "two texts"), (None, "lonely"), (None, None)]
    return spark.createDataFrame([(i, t, "en", "n", "f", "p", 1, 2, "k") for i, t in rows], DOCS)


# ---- fill in the middle
def cut_by_hand(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    if h4 % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_in_middle(docs):
    made = fim.fill_in_middle(docs).withColumn("back", fim.restore())
    assert set(made.columns) == {*docs.columns, "n", "cut_ranks", "output", "prefix_chars", "middle_chars", "back"} - {"N"}
    rows = made.collect()
    assert len(rows) == docs.count() and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == cut_by_hand(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["lang"] == "en"
    assert fim.fill_in_middle(docs.filter("false")).count() == 0
    assert {r["form"] for r in fim.fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}


@pytest.mark.parametrize("seed", range(6))
def test_rank_index_is_exact_and_small(seed):
    rng = np.random.default_rng(seed)
    steps = rng.integers(1, [2, 12, 300, 5, 100000, 9][seed], 20000)
    steps[rng.integers(0, 20000, 20)] += 5000
    offsets = np.cumsum(steps)
    index = fim.RankIndex()
    for part in np.array_split(offsets, 7):
        index.extend(part)
    index.freeze()
    assert (index.offset(np.arange(20000)) == offsets).all()
    assert index.residuals.dtype == np.int8 and np.abs(index.residuals.astype(int)).max() <= fim.ERROR
    if seed in (0, 1, 3, 5):
        assert len(index.first) < 400


def test_boundaries_do_not_depend_on_blocks():
    texts = [t.encode() for t in ("", "abc def", "", "Ünï x9y", "日本abc", "z" * 50, "", "-", "")]
    want = [[m.start() for m in re.finditer(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF]", t)] for t in texts]
    for block in (1, 2, 3, 7, 1000):
        index, ranks, starts = fim.index_texts(texts, block=block)
        for t, (a, b, start) in enumerate(zip(ranks, ranks[1:], starts)):
            assert index.offset(np.arange(a, b)).tolist() == [int(start) + x for x in want[t]]
            assert index.offset(np.array([b]))[0] == start + len(texts[t])
    index, ranks, _ = fim.index_texts([b"", b""])
    assert ranks.tolist() == [0, 0, 0] and index.offset(np.array([0])).tolist() == [0]


# ---- fingerprints
@functools.lru_cache(maxsize=None)
def print_by_hand(text):
    data = text.encode()
    counts = [0] * 256
    for at in range(len(data)):
        for shape, places in enumerate(digest.TRIPLETS):
            if at + places[-1] < len(data):
                a, b, c = (data[at + p] for p in places)
                counts[((shape << 24) + (a << 16) + (b << 8) + c) * 2654435761 % 2 ** 32 >> 24] += 1
    line = sorted(counts)
    code = [sum(c > line[q] for q in (63, 127, 191)) for c in counts]
    digits = bin(len(data))[2:] if data else ""
    length = 4 * len(digits) + (int(digits[1:3], 2) if len(digits) >= 3 else 0)
    return f"{length:02x}" + "".join(f"{4 * code[i] + code[i + 1]:x}" for i in range(0, 256, 2)), length, code


def likeness_by_hand(a, b):
    (_, la, ca), (_, lb, cb) = print_by_hand(a), print_by_hand(b)
    apart = [0, 1, 2, 6]
    difference = sum(apart[abs(x - y)] for x, y in zip(ca, cb)) + 6 * min(12, max(0, abs(la - lb) - 1))
    bound = min(416, sum(apart[x] for x in ca + cb))
    return 1.0 if difference == 0 else 0.0 if bound == 0 else 1 - min(difference, bound) / bound


def test_fingerprints(spark, docs):
    made = digest.fingerprint_documents(docs).collect()
    assert all(r["fingerprint"] == print_by_hand(r["text"] or "")[0] for r in made)
    assert digest.fingerprint_documents(docs.filter("false")).count() == 0
    texts = [r["text"] or "" for r in made]
    rows = [(r["fingerprint"], after["fingerprint"]) for r, after in zip(made, made[1:])] + [(None, "00"), (made[0]["fingerprint"],) * 2]
    scored = digest.compare_fingerprints(spark.createDataFrame(rows, "a string, b string").coalesce(1), "a", "b").collect()
    assert [r["likeness"] for r in scored] == pytest.approx([*[likeness_by_hand(x, y) for x, y in zip(texts, texts[1:])], None, 1.0])


def edits_by_hand(rows):
    """Rows by id, null first; rows with one id are interchangeable as long as their texts are equal."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_by_hand(text)[0], print_by_hand(edited)[0],
                    round(likeness_by_hand(text, edited), 9), round(likeness_by_hand(text, after), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edits_by_the_next_document(spark, docs, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in digest.edit_by_next(docs).collect()), key=repr)
        one = digest.edit_by_next(docs.filter("doc_id = 14")).collect()
        none = digest.edit_by_next(docs.filter("false")).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = F.coalesce("text", F.lit(""))
    rows = [tuple(r) for r in docs.select("doc_id", text.alias("t")).orderBy(F.col("doc_id"), F.xxhash64("t")).collect()]
    assert got == edits_by_hand(rows)
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert none == 0


def test_an_edit_is_nearer_than_another_text(spark, sf):
    rows = digest.edit_by_next(spark.read.parquet(f"{sf}/documents.parquet")).filter("n_chars >= 200").collect()
    assert np.mean([r["near_edited"] > r["near_next"] or r["near_next"] == 1 for r in rows]) >= 0.99
    assert np.median([r["near_edited"] for r in rows]) >= 0.7 and np.median([r["near_next"] for r in rows]) <= 0.3


# ---- centroids
def clusters_by_hand(rows, dim, count, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in kept[:count]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        centres = [[sum(x) // len(x) for x in zip(*[v for (_, v), a in zip(kept, at) if a == n])] or c if n in at else c
                   for n, c in enumerate(centres)]
    far = [(i, *near(v)) for i, v in kept]
    sums = {n: sum(d for _, d, m in far if m == n) for n in range(len(centres))}
    return sorted(((i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                   for i, d, n in far), key=repr)


@pytest.mark.parametrize("spread", [0.05, 3.0, 900.0])
def test_centroids(spark, spread):
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * spread)]) for i in range(300)]
    rows += [(300, rows[0][1]), (0, rows[0][1]), (7, rows[9][1]), (None, rows[3][1]), (301, None), (302, [1.0]), (303, [0.0] * 5 + [float("nan")]),
             (304, [0.0] * 5 + [None]), (305, [float("inf")] * 6), (306, []), (307, [0.0] * 6), (308, [0.0] * 7), (309, [-0.001] * 6)]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id bigint, embedding array<float>, cluster int, distance string")
    for count in (9, 1, 1000):
        found = lookup.with_inertia(*lookup.cluster_vectors(table, dim=6, count=count))
        got = sorted((tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
        assert got == clusters_by_hand(rows, 6, count)
    empty = lookup.with_inertia(*lookup.cluster_vectors(table.filter("vec_id > 300 and vec_id < 307"), dim=6))
    assert empty.count() == 0


def test_tables_equal_direct_distances():
    rng = np.random.default_rng(14)
    for scale in (3, 300, 10 ** 6, lookup.LARGEST):
        block, centres = rng.integers(-scale, scale + 1, (500, 8)), rng.integers(-scale, scale + 1, (7, 8))
        assert (lookup.distances(block, centres) == np.square(block[:, None, :] - centres[None]).sum(axis=2)).all()


def test_components_beyond_a_long_are_held(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e308, 1.0]), (3, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assigned, centres = lookup.cluster_vectors(table, dim=2, count=1)
    assert assigned.count() == 3 and np.abs(centres).max() <= lookup.LARGEST
    assert lookup.with_inertia(assigned, centres).filter("distance >= 0 and inertia >= 0").count() == 3
