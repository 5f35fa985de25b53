"""Every stage of the pipeline against a brute-force version over the rows that its predecessor kept."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import corpus_pipeline
from corpusq.llm import mixing, queries, sharding
from tests.llm.test_llm import hits

#: The field learns from labelled documents; the smallest tables hold too few toxic ones.
SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_by_similarity(docs):
    """Ids of the smallest member of each component of documents that share 75 % of their five-word shingles."""
    sets, holders, root = {}, defaultdict(list), {}
    for doc_id, text in docs:
        found = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc_id] = {tuple(found[i:i + 5]) for i in range(max(len(found) - 4, 1))} if found else set()
        root[doc_id] = doc_id

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for doc_id, made in sets.items():
        for shingle in made:
            holders[shingle].append(doc_id)
    shared = Counter((a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[i + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {a for a in sets if find(a) == a}


def expected_targets(sizes):
    """Target of each source: shares by weight, held at three times the size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in held]
        level = (total - sum(held.values())) / max(sum(weight[s] for s in open_), 1)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**held, **{s: level * weight[s] for s in open_}}
        held.update({s: 3 * sizes[s] for s in over})


def test_stages_against_brute_force(spark, tmp_path):
    read = spark.read.parquet
    docs = read(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-duplicates", "decontamination", "mixing", "sharding"]

    def step(name, before):
        stages[name](spark, before, SF).write.parquet(str(tmp_path / name))
        return read(str(tmp_path / name))

    # the stage drops what the scores reject, and all that it drops is labelled toxic where a label exists
    clean = step("toxicity", docs)
    scores = queries.QUERIES["op10_toxicity"](spark, SF)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in scores.filter("predicted = 0").collect()}
    labelled = {r["doc_id"]: r["toxic"] for r in read(f"{SF}/labels.parquet").collect()}
    left = Counter(labelled[r["doc_id"]] for r in clean.collect() if r["doc_id"] in labelled)
    assert left[0] >= 0.95 * sum(v == 0 for v in labelled.values()) and left[1] <= 0.2 * sum(v == 1 for v in labelled.values())

    single = step("near-duplicates", clean)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(kept_by_similarity([(r["doc_id"], r["text"]) for r in clean.collect()]))

    pure = step("decontamination", single)
    windows = []
    for r in read(f"{SF}/benchmark.parquet").collect():
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or ""))
        windows += [(str(r["item_id"]), found[a:a + 10]) for a in range(max(1, len(found) - 9) if found else 0)]
    assert sorted(r["doc_id"] for r in pure.collect()) == sorted(r["doc_id"] for r in single.collect() if not hits(r["text"], windows)[1])

    mixed = step("mixing", pure)
    rows = [(r["doc_id"], r["source"], len(words(r["text"]))) for r in pure.collect()]
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    targets = expected_targets(sizes)
    want = Counter()
    for doc_id, source, _ in rows:
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        draw = int(md5(f"{mixing.SEED}:{doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[doc_id] += int(rate) + (draw < rate - int(rate))
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want

    assert all(frame.columns == docs.columns for frame in (clean, single, pure, mixed))
    final = step("sharding", mixed).collect()
    assert Counter(r["doc_id"] for r in final) == +want
    assert all((r["size"], r["text_crc32"]) == (len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in final)
    slots, shards, load = defaultdict(list), defaultdict(set), Counter()
    for r in final:
        slots[r["shard"]].append(r["slot"])
        shards[r["text"] or ""].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(sharding.SHARDS))
    assert all(len(s) == 1 for s in shards.values())
    # no shard is heavier than the mean by more than the heaviest group
    groups = Counter()
    for r in final:
        groups[r["text"] or ""] += r["size"]
    assert max(load.values()) <= sum(load.values()) / sharding.SHARDS + max(groups.values())


def test_run_returns_what_the_stages_return(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(rows.columns)
    assert rows.groupBy("shard", "slot").count().filter("count > 1").count() == 0 and rows.count() > 0
