"""Near-duplicates by fast similarity sketching, banding and exact verification.

A text's set holds its distinct five-word shingles as 64-bit hashes.  Its sketch
has COORDINATES numbers: in round i every shingle is hashed to a bin and a
value, and a bin keeps the smallest (round, value); after COORDINATES rounds
each further round fills one bin, so every coordinate is filled after twice as
many rounds, and long before that for all but the shortest texts.  Bands of ROWS
coordinates collide with probability J ** ROWS; at similarity 0.75 a pair meets
in one of BANDS bands with probability 1 - 5e-6.

Equal sets are one node.  The nodes of a band value (a bucket) are compared with
its centre, the node that meets most others over all bands, which joins most of
a group of copies with one comparison per node and centre.  Buckets whose nodes
are all in one component are done.  In the rest, every pair of different
components is verified, in cells of bounded size.  Links are verified on the
full sets: 100 * intersection >= 75 * union.

Nulls: a null text, and one without words, has an empty set and is linked with
nothing.  Fewer than five words are one shingle.  A null id is linked with
nothing, has a null component and is kept.  Rows that repeat an id are each
returned.  An empty table gives an empty result.  Other columns are kept by
``drop_near_duplicates``; columns named like a result are replaced.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusq.llm.arrow import extend, pieces, text_bytes
from corpusq.llm.components import components
from corpusq.plans.scratch import shared_folder

WORDS = 5
COORDINATES = 128
BANDS = 32
ROWS = COORDINATES // BANDS
#: Documents whose ids may be broadcast to pick their texts; with more, texts and ids are shuffled.
BROADCAST_IDS = 500_000
#: Members and shingles of a block of a bucket; two blocks are held by a task at once.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 2_000_000
#: Distinct words whose hashes a task remembers.
REMEMBERED = 200_000

_BIN_BITS = COORDINATES.bit_length() - 1
_VALUE_BITS = 64 - 8 - 1  # round number above, value below
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit result."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: list, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, text by text; how many each text has)."""
    flat, counts = [], []
    for data in texts:
        found = data.lower().split() if data else []
        counts.append(len(found))
        flat.extend(map(hashes.__getitem__, found))
    numbers = np.array(flat, dtype=np.uint64)
    counts = np.array(counts, dtype=np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(counts) - counts
    # rolling combination of five words; a shorter text is one sequence with its length mixed in
    made = np.zeros(len(numbers), dtype=np.uint64)
    position = np.arange(len(numbers)) - np.repeat(start, counts)
    width = np.repeat(np.minimum(counts, WORDS), counts)
    for step in range(WORDS):
        shifted = np.zeros(len(numbers), dtype=np.uint64)
        if step < len(numbers):
            shifted[:len(numbers) - step] = numbers[step:]
        made = np.where(step < width, mix(made * _ODD + shifted), made)
    made = mix(made + width.astype(np.uint64))
    whole = position + width <= np.repeat(counts, counts)
    text, made = text[whole], made[whole]
    order = np.lexsort((made, text))
    text, made = text[order], made[order]
    fresh = np.ones(len(made), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (made[1:] != made[:-1])
    return made[fresh], np.bincount(text[fresh], minlength=len(counts)).astype(np.int64)


def sketch(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """COORDINATES numbers per text (rows of the result); texts without shingles keep the largest number."""
    n = len(counts)
    cells = np.full(n * COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    text = np.repeat(np.arange(n), counts)
    open_values, open_text = values, text
    mask = np.uint64((1 << _VALUE_BITS) - 1)
    for i in range(2 * COORDINATES):
        if not len(open_values):
            break
        hashed = mix(open_values ^ mix(np.full(1, i + 1, dtype=np.uint64) * _ODD))
        bins = (hashed >> np.uint64(64 - _BIN_BITS)).astype(np.int64) if i < COORDINATES else np.int64(i - COORDINATES)
        np.minimum.at(cells, open_text * COORDINATES + bins, (np.uint64(i) << np.uint64(_VALUE_BITS)) | (hashed & mask))
        # texts with an empty bin go on
        full = (cells.reshape(n, COORDINATES) != np.iinfo(np.uint64).max).all(axis=1)
        stay = ~full[open_text]
        if not stay.all():
            open_values, open_text = open_values[stay], open_text[stay]
    return cells.reshape(n, COORDINATES)


def band_keys(cells: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys per text."""
    grouped = cells.reshape(len(cells), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, (len(cells), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * _ODD + grouped[:, :, r])
    return key


def _fingerprints(values, counts):
    """16 bytes per text that identify its set."""
    ends = np.cumsum(counts)
    return [xxhash.xxh3_128_digest(values[e - c:e].tobytes()) if c else None for e, c in zip(ends, counts)]


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands): set_id is null for an empty set."""
    def factory():
        hashes = _Hashes()

        def compute(batch):
            texts = text_bytes(batch.column(1))
            sizes, ids, bands = [], [], []
            for low, high in pieces(texts):
                values, counts = shingle_sets(texts[low:high], hashes)
                keys = band_keys(sketch(values, counts)).view(np.int64)
                sizes += counts.tolist()
                ids += _fingerprints(values, counts)
                bands += [k if c else None for k, c in zip(keys, counts)]
            return [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return compute
    return extend(docs.select("doc_id", "text"), "n_shingles bigint, set_id binary, bands array<bigint>", factory).drop("text")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder, so that lost executors do not start the chain anew."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) of the wanted (set_id, doc_id)."""
    ids = wanted.select("doc_id").distinct()
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def factory():
        hashes = _Hashes()

        def compute(batch):
            texts = text_bytes(batch.column(1))
            ids, sets = [], []
            for low, high in pieces(texts):
                values, counts = shingle_sets(texts[low:high], hashes)
                ids += _fingerprints(values, counts)
                sets += np.split(values.view(np.int64), np.cumsum(counts)[:-1])
            return [pa.array(ids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
        return compute
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = extend(texts, "set_id binary, shingles array<bigint>", factory).drop("text")
    # an id that repeats with other texts must not bring their sets along
    return sets.join(wanted, ["set_id", "doc_id"], "left_semi").select("set_id", "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("_of_b"))
    right = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("_of_a"))
    both = pairs.join(left, "b").join(right, "a")
    shared = F.size(F.array_intersect("_of_a", "_of_b"))
    return (both.select("a", "b", shared.alias("_shared"), (F.size("_of_a") + F.size("_of_b")).alias("_sum"))
            .filter(F.col("_shared") * 100 >= (F.col("_sum") - F.col("_shared")) * percent).select("a", "b"))


def _size_bound(percent: int):
    """Sets that differ more in size cannot be that similar."""
    return F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent


class _Cell:
    """Members of one bucket, or of two of its blocks, with their full sets."""

    def __init__(self, group: tuple):
        self.group, self.band = group, 0
        self.ids, self.roots, self.blocks, self.keys, self.sets = [], [], [], [], []

    def links(self, percent: int) -> list:
        """Pairs of different components that are similar; a pair is looked at in its first common band only."""
        if len(self.ids) < 2:
            return []
        numbers = {}
        roots = np.array([numbers.setdefault(r, len(numbers)) for r in self.roots])
        blocks, keys, sizes = np.array(self.blocks), np.stack(self.keys), np.array([len(s) for s in self.sets])
        found, crossing = [], self.group[1] != self.group[2]
        for i in range(len(self.ids) - 1):
            later = slice(i + 1, None)
            look = roots[later] != roots[i]
            look &= np.minimum(sizes[later], sizes[i]) * 100 >= np.maximum(sizes[later], sizes[i]) * percent
            if crossing:
                look &= blocks[later] != blocks[i]
            if self.band:
                look &= ~(keys[later, :self.band] == keys[i, :self.band]).any(axis=1)
            for j in (np.flatnonzero(look) + i + 1).tolist():
                shared = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                if shared * 100 >= (sizes[i] + sizes[j] - shared) * percent:
                    found.append((self.ids[i], self.ids[j]))
        return found


CELL = ["key", "left", "right", "band", "set_id", "root", "block", "bands", "shingles"]


def _search_cells(percent: int):
    def run(batches):
        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])
        cell = None
        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:7]]
            for at, (key, left, right, band, set_id, root, block) in enumerate(zip(*plain)):
                if cell is None or cell.group != (key, left, right):
                    if cell is not None:
                        yield out(cell.links(percent))
                    cell = _Cell((key, left, right))
                    cell.band = band
                cell.ids.append(set_id)
                cell.roots.append(root)
                cell.blocks.append(block)
                cell.keys.append(batch.column(7)[at].values.to_numpy(zero_copy_only=False))
                cell.sets.append(batch.column(8)[at].values.to_numpy(zero_copy_only=False).copy())
        if cell is not None:
            yield out(cell.links(percent))
    return run


def _loose_links(met: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links in the buckets whose members are not all of one component.

    A bucket with more than BLOCK_ROWS members or BLOCK_SHINGLES shingles is cut
    into blocks, and every two of its blocks meet in a cell of bounded size.
    """
    placed = (met.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left")
              .select("key", "band", "set_id", "size", F.coalesce("root", "set_id").alias("root")))
    mixed = (placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"))
             .filter("_low <> _high")
             .select("key", F.ceil(F.greatest(F.col("_n") / BLOCK_ROWS, F.col("_size") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    members = (_kept(placed.join(mixed, "key"), "mixed").withColumn("block", block)
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")))
    carried = sets.join(nodes.select("set_id", "bands"), "set_id")
    return (members.join(carried, "set_id").select(*CELL)
            .repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "set_id")
            .mapInArrow(_search_cells(percent), "a binary, b binary"))


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_id), one row per row of ``docs``."""
    sketches = _kept(sketch_documents(docs), "sketches")
    rows = sketches.filter("set_id is not null and doc_id is not null")
    nodes = _kept(rows.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"),
                                             F.first("bands").alias("bands")), "sets")
    keyed = nodes.select("set_id", "size", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = _kept(keyed.join(shared, "key"), "bands")
    # the centre of a bucket is the member that meets most others over all bands: in a group of copies, the original
    fame = met.groupBy("set_id").agg(F.sum("n").alias("fame"))
    centres = (met.join(fame, "set_id").groupBy("key").agg(F.max(F.struct("fame", "set_id", "size")).alias("_c"))
               .select("key", F.col("_c.set_id").alias("a"), F.col("_c.size").alias("a_size")))
    stars = (met.select("key", F.col("set_id").alias("b"), F.col("size").alias("b_size")).join(centres, "key")
             .filter("a <> b").filter(_size_bound(percent)).select("a", "b").distinct())
    sets = _kept(_full_sets(docs, nodes.join(fame, "set_id", "left_semi").select("set_id", "doc_id")), "full-sets")
    links = _kept(_verified(stars, sets, percent), "links")
    roots = components(links, "a", "b")
    more = _kept(_loose_links(met, nodes, sets, roots, percent), "more-links")
    if not more.isEmpty():
        roots = components(links.union(more), "a", "b")

    classes = (nodes.select("set_id", "doc_id").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left")
               .withColumn("root", F.coalesce("root", "set_id")))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(least, "root").select("set_id", "component_id")
    out = (sketches.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id",
                      (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"), "set_id")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    return _judged(docs, percent).drop("set_id")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows


def _losing_texts(docs: DataFrame, lost: DataFrame, torn: DataFrame) -> DataFrame:
    """(_lost, _digest) of the rows of torn ids whose set is lost; only the texts of these ids are hashed again."""
    def factory():
        hashes = _Hashes()

        def compute(batch):
            texts, ids = text_bytes(batch.column(1)), []
            for low, high in pieces(texts):
                ids += _fingerprints(*shingle_sets(texts[low:high], hashes))
            return [pa.array(ids, pa.binary())]
        return compute
    texts = docs.select("doc_id", "text").join(_few(torn), F.col("doc_id") == F.col("_torn"), "left_semi")
    sets = extend(texts, "set_id binary", factory)
    return (sets.join(lost, (sets["doc_id"] == lost["_lost"]) & (sets["set_id"] == lost["set_id"]), "left_semi")
            .select(F.col("doc_id").alias("_lost"), _digest("text").alias("_digest")).distinct())


def _digest(text):
    return F.sha2(F.col(text).cast("binary"), 256)


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, whole, of which each component keeps the one with the smallest id.

    Rows are dropped by id.  Where an id repeats with other texts and only some
    of its rows are lost, those are dropped by id and text.
    """
    judged = _kept(_judged(docs, percent).select("doc_id", "set_id", "kept"), "judged")
    lost = judged.filter("not kept").select(F.col("doc_id").alias("_lost"), "set_id")
    ids = _kept(lost.select("_lost"), "lost")
    torn = _kept(judged.filter("kept").select(F.col("doc_id").alias("_torn"))
                 .join(_few(ids), F.col("_torn") == F.col("_lost"), "left_semi").distinct(), "torn")
    texts = None
    if not torn.isEmpty():
        ids = ids.join(_few(torn), F.col("_lost") == F.col("_torn"), "left_anti")
        texts = _kept(_losing_texts(docs, lost, torn), "losing-texts")
    ids = _few(ids)
    left = docs.join(ids, docs["doc_id"] == ids["_lost"], "left_anti")
    if texts is None:
        return left
    texts = _few(texts)
    return left.join(texts, (docs["doc_id"] == texts["_lost"]) & (_digest("text") == texts["_digest"]), "left_anti")
