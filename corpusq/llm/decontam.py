"""Benchmark decontamination: exact containment of item windows in documents.

A window is ten consecutive item words; a shorter item is one window.  Its
tokens are its shingles of three words (the whole window where it is shorter),
ordered by rarity: the number of documents that hold them, counted over all
documents.  Containment of the whole window needs every token, so the prefix of
a window is its rarest shingle.  Document shingles meet the prefixes; each
meeting fixes where the window would begin; position and length bounds discard
those that would leave the document; the rest are compared word by word.

Windows are taken in blocks of bounded size.  Each block is held by the tasks
and takes two narrow passes over the documents (counting, then matching) that
shuffle no text.  One block or many give the same result.

Nulls: a null or empty text has no words.  A null item id hits words but is not
listed.  Equal windows of several items count for each; repeated items and
documents are defined (a document per row, an item per id).  An empty table on
either side gives no hits.  Other columns of the documents are kept; columns
named like a result are replaced.
"""

import numpy as np
import pyarrow as pa
from itertools import repeat
from pyspark.sql import DataFrame, functions as F

from corpusq.llm.arrow import extend, pieces, text_bytes
from corpusq.llm.columns import hold, release
from corpusq.plans.scratch import shared_folder
from corpusq.plans.shipping import Held

WINDOW = 10
SHINGLE = 3
#: Windows that a task holds at once (about 100 bytes each).
BLOCK_WINDOWS = 100_000

# A-Z to a-z, digits, a-z and all bytes of non-ASCII characters kept, the rest separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, items): distinct windows as words joined by a space, with the sorted ids of their items."""
    def cut(batches):
        for batch in batches:
            windows, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                found = words(text or b"")
                for at in range(max(1, len(found) - size + 1) if found else 0):
                    windows.append(b" ".join(found[at:at + size]).decode())
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(items, pa.string())], names=["window", "item"])
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "window string, item string")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Block:
    """Windows of one block as word numbers, and their shingles by length."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        split = [w.encode().split(b" ") for w, _ in rows]
        self.items = [i for _, i in rows]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for s in split for w in s}), 1)}
        self.base = len(self.vocabulary) + 1
        ids = [np.array([self.vocabulary[w] for w in s], dtype=np.int64) for s in split]
        self.length = np.array([len(i) for i in ids], dtype=np.int64)
        self.by_length = {}
        for n in np.unique(self.length):
            at = np.flatnonzero(self.length == n)
            self.by_length[int(n)] = (at, np.stack([ids[i] for i in at]))
        # per shingle length: sorted distinct shingles of the windows
        self.shingles = {}
        for n, (_, matrix) in self.by_length.items():
            size = min(SHINGLE, n)
            self.shingles.setdefault(size, []).append(np.unique(self._keys(matrix, size)))
        self.shingles = {s: np.unique(np.concatenate(k)) for s, k in self.shingles.items()}
        self.offsets, total = {}, 0
        for size, keys in sorted(self.shingles.items()):
            self.offsets[size] = total
            total += len(keys)
        self.total = total
        self.prefixes = None

    def _keys(self, matrix, size):
        """Number of each shingle along the last axis; 0 where it holds an unknown word."""
        last = matrix.shape[-1] - size + 1
        key = matrix[..., :last].copy()
        known = key > 0
        for step in range(1, size):
            part = matrix[..., step:step + last]
            key = key * self.base + part
            known &= part > 0
        return np.where(known, key, 0)

    def order(self, frequency: dict):
        """Choose each window's rarest shingle; ties go to the earlier one."""
        counts = np.zeros(self.total, dtype=np.int64)
        for at, n in frequency.items():
            counts[at] = n
        gathered = {}
        for n, (at, matrix) in self.by_length.items():
            size = min(SHINGLE, n)
            keys = self._keys(matrix, size)
            place = np.searchsorted(self.shingles[size], keys)
            rarest = np.argmin(counts[place + self.offsets[size]], axis=1)
            rows = np.arange(len(at))
            gathered.setdefault(size, []).append((keys[rows, rarest], at, rarest, np.full(len(at), n)))
        self.prefixes = {}
        for size, parts in gathered.items():
            key, window, offset, length = (np.concatenate(c) for c in zip(*parts))
            by = np.argsort(key, kind="stable")
            distinct, first = np.unique(key[by], return_index=True)
            self.prefixes[size] = (distinct, np.append(first, len(key)), window[by], offset[by], length[by])
        self.place = np.zeros(len(self.items), dtype=np.int64)
        for at, _ in self.by_length.values():
            self.place[at] = np.arange(len(at))

    def numbers(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers of all texts, a 0 after each text; starts; word counts)."""
        flat, counts, get = [], np.zeros(len(texts), dtype=np.int64), self.vocabulary.get
        for i, data in enumerate(texts):
            if data:
                found = words(data)
                counts[i] = len(found)
                flat.extend(map(get, found, repeat(0)))
            flat.append(0)
        starts = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
        return np.array(flat, dtype=np.int64), starts, counts

    def _meet(self, ids, size, keys):
        """(positions, index into keys) where a shingle of the texts is one of the sorted keys."""
        if len(ids) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first = np.zeros(self.base, dtype=bool)
        first[keys // self.base ** (size - 1)] = True
        first[0] = False
        at = np.flatnonzero(first[ids[:len(ids) - size + 1]])
        key, known = ids[at], np.ones(len(at), dtype=bool)
        for step in range(1, size):
            part = ids[at + step]
            key = key * self.base + part
            known &= part > 0
        at, key = at[known], key[known]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = keys[place] == key
        return at[same], place[same]

    def count(self, texts: list, totals: np.ndarray):
        """Add the number of texts that hold each shingle."""
        ids, starts, _ = self.numbers(texts)
        for size, keys in self.shingles.items():
            at, place = self._meet(ids, size, keys)
            doc = np.searchsorted(starts, at, side="right") - 1
            pairs = np.unique(doc * len(keys) + place)
            np.add.at(totals, pairs % len(keys) + self.offsets[size], 1)

    def match(self, texts: list):
        """(starts, word counts, begins, lengths, windows) of every occurrence of a window."""
        ids, starts, counts = self.numbers(texts)
        begins, lengths, windows = [], [], []
        for size, (keys, first, window, offset, length) in self.prefixes.items():
            at, place = self._meet(ids, size, keys)
            for low in range(0, len(at), 1 << 16):
                a, p = at[low:low + (1 << 16)], place[low:low + (1 << 16)]
                n = first[p + 1] - first[p]
                entry = np.repeat(first[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(a, n) - offset[entry]
                inside = (begin >= 0) & (begin + length[entry] <= len(ids))
                begin, entry = begin[inside], entry[inside]
                for size_of, (_, matrix) in self.by_length.items():
                    of = length[entry] == size_of
                    b, w = begin[of], window[entry[of]]
                    if not len(b):
                        continue
                    same = (ids[b[:, None] + np.arange(size_of)] == matrix[self.place[w]]).all(axis=1)
                    begins.append(b[same])
                    windows.append(w[same])
                    lengths.append(np.full(int(same.sum()), size_of))
        empty = [np.zeros(0, dtype=np.int64)]
        return starts, counts, *(np.concatenate(x or empty).astype(np.int64) for x in (begins, lengths, windows))


def _spans(mask: np.ndarray) -> list:
    """Runs of True as [start, end) word positions."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])]


FOUND = "n_words bigint, hit_spans array<struct<start: bigint, end: bigint>>, items array<string>"


def _add_block(docs: DataFrame, shared) -> DataFrame:
    """Merge the occurrences of one block into n_words, hit_spans (word positions) and items."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    had = {c: f"_had_{c}" for c in ("hit_spans", "items")}
    renamed = docs.withColumnsRenamed(had)

    def factory():
        block = shared.get()

        def compute(batch):
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            texts = text_bytes(column("text"))
            old_spans, old_items = column("_had_hit_spans").to_pylist(), column("_had_items").to_pylist()
            n_words, spans, items = [], [], []
            for low, high in pieces(texts):
                starts, counts, begins, lengths, windows = block.match(texts[low:high])
                doc = np.searchsorted(starts, begins, side="right") - 1
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(len(counts) + 1))
                for i in range(high - low):
                    mine = order[cuts[i]:cuts[i + 1]]
                    was = old_spans[low + i] or []
                    n_words.append(int(counts[i]))
                    if not len(mine):
                        spans.append(was)
                        items.append(old_items[low + i] or [])
                        continue
                    edge = np.zeros(counts[i] + 1, dtype=np.int64)
                    np.add.at(edge, begins[mine] - starts[i], 1)
                    np.add.at(edge, begins[mine] - starts[i] + lengths[mine], -1)
                    for s in was:
                        edge[s["start"]] += 1
                        edge[s["end"]] -= 1
                    spans.append(_spans(np.cumsum(edge)[:-1] > 0))
                    found = set(old_items[low + i] or [])
                    for w in np.unique(windows[mine]):
                        found.update(block.items[w])
                    items.append(sorted(found))
            return [pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
        return compute
    return extend(renamed, FOUND, factory).drop(*had.values())


def _frequencies(docs: DataFrame, shared) -> dict:
    """Documents per shingle of the block, summed per task before the shuffle; one row per shingle comes back."""
    def count(batches):
        block = shared.get()
        totals = np.zeros(block.total, dtype=np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for low, high in pieces(texts):
                block.count(texts[low:high], totals)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(totals[held], pa.int64())], names=["place", "n"])
    rows = docs.select("text").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    return {r["place"]: r["n"] for r in rows}


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Documents with n_words, hit_spans (word positions, merged) and items (ids with an occurring window)."""
    spark = docs.sparkSession
    windows = item_windows(benchmark, size)
    path = shared_folder(spark, "item-windows")
    windows.write.parquet(path)
    windows = spark.read.parquet(path)
    blocks = max(1, -(-windows.count() // block_windows))
    out = (docs.drop("n_words", "hit_spans", "items", "_had_hit_spans", "_had_items")
           .withColumn("hit_spans", F.array().cast("array<struct<start: bigint, end: bigint>>"))
           .withColumn("items", F.array().cast("array<string>")))
    numbered = windows.withColumn("_block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    for b in range(blocks):
        rows = numbered.filter(F.col("_block") == b).orderBy("window").collect()
        block = Block([(r["window"], r["items"]) for r in rows])
        block.order(_frequencies(docs, Held(spark, block)) if rows else {})
        out = _add_block(out, Held(spark, block))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, whole and with their own columns untouched, in which no window occurs."""
    need = ["doc_id", "text"]
    found = find_contamination(hold(docs, need), benchmark, size)
    return release(found.filter("size(hit_spans) = 0"), docs.columns, need)
