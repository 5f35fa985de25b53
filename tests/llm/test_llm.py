"""The ten operators on small fixtures with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import chat, decontam, hnsw, labelled, mixing, neardup, quality, queries, secrets, sharding, toxicity, urls

DOCS = "doc_id bigint, text string, lang string, source string, shard int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    near = " ".join(["other", *words[1:]])
    secret = 'é api_key = "abc123XYZ" AKIA' + "A1" * 9 + " " + "0123456789abcdef" * 2
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, "", "en", None), (5, None, None, "b"),
            (6, "one two", "en", "c"), (7, secret, "fr", "c"), (7, secret, "fr", "c"), (None, "lonely row", "en", "a"),
            (8, ("long text " * 30000), "en", "b")]
    return spark.createDataFrame([(*r, 9, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def base_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate([
            ("assign", r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(found))


def test_secrets(docs, none):
    found, ledger = secrets.scan_secrets(docs)
    got = [(r["doc_id"], r["text"], r["s"]) for r in found.select("doc_id", "text", secrets.span_text().alias("s")).collect()]
    assert len(got) == docs.count() and all(s == base_spans(t or "") for _, t, s in got)
    assert any(s.count(":") == 6 for _, _, s in got)
    # a second run scans only what is new: another text, and a rule with a new version
    assert secrets.scan_unseen(docs, ledger).count() == 0
    newer = tuple(r._replace(version=2) if r.kind == "hex" else r for r in secrets.RULES)
    again = secrets.scan_unseen(docs, ledger, newer)
    assert {r["rule"] for r in again.collect()} == {"hex"}
    assert secrets.scan_secrets(none)[0].count() == 0


def test_crawls_share_one_ledger(spark, docs):
    """Every blob is scanned once, by the first crawl that holds it, and findings reach the paths of all crawls."""
    rows = docs.withColumn("crawl", F.when(F.col("lang") == "fr", 1).otherwise(0)).unionByName(
        docs.withColumn("crawl", F.lit(2)).withColumn("doc_id", F.col("doc_id") + 100))
    ledger, scanned = None, []
    for i in range(3):
        before = 0 if ledger is None else ledger.count()
        _, ledger = secrets.scan_secrets(rows.filter(F.col("crawl") == i), ledger)
        scanned.append(ledger.count() - before)
    blobs = docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().count()
    assert sum(scanned) == blobs * len(secrets.RULES) and scanned[2] == 0 and min(scanned[:2]) > 0
    found = secrets.join_findings(rows, ledger).select("text", secrets.span_text().alias("s")).collect()
    assert len(found) == 2 * docs.count() and all(r["s"] == base_spans(r["text"] or "") for r in found)


def test_mixing(docs, none):
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == docs.count() and all(0 <= r["copies"] <= 3 for r in plan)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in plan}
    assert abs(sum(t for t, _ in targets.values()) - sum(r["size"] for r in plan)) < 1e-6
    assert all(t <= 3 * s for t, s in targets.values())
    assert mixing.mix(docs).count() == sum(r["copies"] for r in plan)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none).count() == 0


def test_neardup(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: (56, 1, True), 2: (56, 1, False), 3: (56, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (1, 6, True),
                   7: (got[7][0], 7, True), None: (1, None, True), 8: (2, 8, True)}
    assert sorted(r["doc_id"] or 0 for r in neardup.drop_near_duplicates(docs).collect()) == [0, 1, 4, 5, 6, 7, 7, 8]
    assert neardup.near_duplicates(none).count() == 0


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, "x"), (5, b, "y"), (3, b, "z"), (9, a, "v"), (5, "", "e"), (5, None, "n"), (7, c, "c1"), (8, c, "c2"), (None, b, "no id")]
    got = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, note string"))
    assert got.columns == ["doc_id", "text", "note"]
    assert sorted(r["note"] for r in got.collect()) == ["c1", "e", "n", "no id", "x", "z"]


def test_sketch_is_a_similarity_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    cells = neardup.sketch(np.concatenate([a, b, a[:1]]), np.array([700, 700, 1]))
    assert (cells != np.iinfo(np.uint64).max).all()
    assert abs((cells[0] == cells[1]).mean() - 600 / 800) < 0.15


def test_cells_find_every_link_of_an_unjoined_bucket():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    cell = neardup._Cell(("k", 0, 0))
    cell.ids, cell.roots, cell.blocks = list(range(30)), list(range(30)), [0] * 30
    cell.keys, cell.sets = [np.arange(i * 32, i * 32 + 32) for i in range(30)], sets
    want = {(i, j) for i in range(30) for j in range(i + 1, 30)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 40 * len(np.union1d(sets[i], sets[j]))}
    assert set(cell.links(40)) == want and want


@pytest.mark.parametrize("text", ["", "plain", "\\", "a\\", "\\\\", r"\### Assistant: </turn> ok", "### User: x</turn>\n", "####", "\\</turn>", "é\n\n"])
def test_chat_turn(text):
    for role in ("user", "", "a: b", "x</turn>", "\\"):
        assert [t[:2] for t in chat.parse(chat.render(role, text) * 2)] == [(role, text)] * 2


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, None, None), (2, None, "user", "### x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, hashlib.sha256(b"bb").hexdigest())
    assert got[None]["n_turns"] == 1 and chat.read_back(chat.format_turns(turns.filter("false"))).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    points = np.concatenate([centres + 0.12 * rng.normal(size=centres.shape) for _ in range(12)])
    rows = [(i, [float(x) for x in np.float32(p)], i % 2) for i, p in enumerate(points)]
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, rows[0][1], None), (1004, [float("nan")] * 16, 1), (1005, [1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    sound = [r for r in rows if r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1]) and len(r[1]) == 16]
    unit = np.array([r[1] for r in sound])
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    label = np.array([r[2] for r in sound])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(sound), dtype=bool)
    for size in (4096, 60):
        got = {r["vec_id"]: r["n_links"] for r in hnsw.near_vectors(table, shard_rows=size).collect()}
        assert len(got) == len(rows) and all(got[i] == 0 for i in range(1001, 1006))
        assert sum(got.values()) >= 0.98 * near.sum() and all(got[r[0]] <= n for r, n in zip(sound, near.sum(axis=1)))
    assert hnsw.near_vectors(table.filter("false")).count() == 0


def test_recall_over_several_full_shards(spark):
    """One label, four shards of about a thousand vectors, a hot group among them."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(300, 24))
    points = np.float32(np.concatenate([centres[i % 300] + 0.14 * rng.normal(size=(1, 24)) for i in range(3600)] + [
        centres[:1] + 0.05 * rng.normal(size=(400, 24))]))
    unit = points.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(i, [float(x) for x in p], 7) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_vectors(table, shard_rows=1000).collect()}
    links = near.sum(axis=1)
    assert sum(n for n, _ in got.values()) >= 0.98 * links.sum() and all(got[i][0] <= links[i] for i in got)
    cold = np.arange(3600)
    assert np.mean([got[i][0] / links[i] for i in cold if links[i]]) >= 0.98
    assert all(got[i][1] <= i for i in got)


def test_audit_counts_every_vector_once():
    """A hot third found whole does not hide that the other nodes and the queries miss their links."""
    rng = np.random.default_rng(5)
    near = np.concatenate([np.ones((200, 1)) + rng.normal(0, 0.01, (200, 24)), rng.normal(size=(400, 24))])
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    graph = hnsw.Graph(near)
    whole = graph._descend

    def blind_below(least, cold):
        def descend(queries, beam, inserted=None):
            ids, cosine = whole(queries, beam, inserted)
            missed = cold(queries)[:, None] & (beam < least)
            return np.where(missed, -1, ids), np.where(missed, -np.inf, cosine)
        return descend
    graph._descend = blind_below(200, lambda q: q @ near[0] < 0.9)
    assert graph.audited_beam(0.93) >= 200
    graph._descend = whole
    shard = hnsw._Shard([bytes([i // 256, i % 256]) for i in range(600)], near, np.ones(600), 0.93)
    before = shard.beam
    asked = rng.normal(size=(30, 24))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    whole = shard.graph._descend
    shard.graph._descend = blind_below(2 * before + 1, lambda q: np.isin(q[:, 0], asked[:, 0]))
    shard.query([b"q%d" % i for i in range(30)], asked, np.ones(30))
    assert shard.beam > 2 * before


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, shards=3).collect()
    assert len(rows) == docs.count()
    for s in range(3):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["size"] == len((r["text"] or "").encode()) + 8 for r in rows)
    assert sharding.shard_documents(none).count() == 0


def test_differencing_beats_greedy():
    sizes = np.sort(np.random.default_rng(4).integers(1, 10**6, 400))[::-1]
    sums = np.bincount(sharding.difference(sizes, 24), sizes, 24)
    greedy = np.zeros(24)
    for size in sizes:
        greedy[greedy.argmin()] += size
    assert np.ptp(sums) <= np.ptp(greedy) and sums.sum() == sizes.sum()


def hits(text, windows):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    marked, items = set(), set()
    for item, window in windows:
        for at in range(len(found) - len(window) + 1):
            if found[at:at + len(window)] == window:
                marked |= set(range(at, at + len(window)))
                items.add(item)
    return len(found), len(marked), sorted(items)


@pytest.mark.parametrize("block", [100000, 7])
def test_decontamination(spark, docs, none, block):
    item = " ".join(f"w{i}" for i in range(5, 25))
    items = [(1, item.upper()), (2, "one two"), (3, None), (4, ""), (5, "Text"), (5, "text"), (None, "lonely"), (6, "w0 w1 w2 w4")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = []
    for i, t in items:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        windows += [(str(i), w[a:a + 10]) for a in range(max(1, len(w) - 9) if w else 0)]
    got = decontam.find_contamination(docs, bench, block_windows=block).collect()
    for r in got:
        n, hit, found = hits(r["text"], windows)
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"])) == (n, hit)
        assert r["items"] == [i for i in found if i != "None"]
    assert decontam.find_contamination(none, bench).count() == 0
    assert all(not r["items"] for r in decontam.find_contamination(docs, bench.filter("false")).collect())


@pytest.mark.parametrize("block", [50000, 2])
def test_urls(spark, block):
    listed = [None, "no scheme", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://example.com", "http://example.com/",
              "http://a.net/es/?q", "http://net/fr/", "http://notexample.com/en/", "ftp://casino-x.org/", "http://x.org/?a=://com/", "http://com/en"]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(listed)], "page_id bigint, url string, verdict string")
    got = [(r["rule"], r["verdict"]) for r in urls.judge_urls(table, block_rules=block).orderBy("page_id").collect()]
    assert got == [(None, "allow"), (None, "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), (None, "allow"), ("com/", "allow"),
                   ("net/es/", "block"), ("net/fr/", "block"), ("com/", "allow"), (None, "block"), (None, "allow"), ("com/", "allow")]
    assert urls.judge_urls(table.filter("false")).count() == 0


def test_trees_match_a_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    one = x[0]
    total = model.base
    for f, t, v in zip(model.feature, model.threshold, model.value):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(one[f[at]] > t[at])
        total += v[at - len(f)]
    assert abs(1 / (1 + np.exp(-total)) - model.score(x[:1])[0]) < 1e-12
    assert np.allclose(quality.fit(x[:5], np.ones(5)).score(x[:2]), 0.999)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(6)
    score, moves, start = rng.normal(size=7), rng.normal(size=(2, 2)), 0.3
    first, last = toxicity._borders(np.array([7]))
    p, _, _ = toxicity.forward_backward(score, start, moves, first, last, 1e-12)
    mass, total = np.zeros(7), 0.0
    for code in range(2 ** 7):
        y = [(code >> i) & 1 for i in range(7)]
        w = np.exp(start * y[0] + score @ np.array(y) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        total += w
        mass += w * np.array(y)
    assert np.allclose(p, mass / total, rtol=1e-8)


@pytest.mark.parametrize("name,label,modulus,left", [("op9_quality", "quality", 4, 2), ("op10_toxicity", "toxic", 3, 1)])
def test_held_out_accuracy(spark, name, label, modulus, left):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    rows = queries.QUERIES[name](spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == left) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) >= 0.93 * len(held)


def test_a_small_share_still_has_its_sample(spark):
    rows = spark.range(40_000_000).withColumnRenamed("id", "doc_id")
    assert 8 <= labelled.thin(rows, 5e-7, "toxicity").count() <= 35
    assert abs(labelled.thin(rows.limit(100_000), 0.3, "quality").count() - 30_000) < 1_000


def test_classifiers_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, None, 1), (6, 0, None), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    stats = quality.text_statistics(docs)
    scored = quality.score_quality(stats, quality.fit_quality(stats, labels, F.lit(True))).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    for table in (labels, labels.filter("false")):
        field = toxicity.fit_toxicity(docs, table, F.lit(True))
        assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, field).collect())
    assert toxicity.score_toxicity(none, field).count() == 0
