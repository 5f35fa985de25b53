"""Document fingerprints: quartile bucket digests with a bounded difference score.

Every window of five bytes gives the six triplets that hold its first byte; each
is hashed, with its shape, to one of BUCKETS buckets.  A bucket's code is the number of quartiles
(of all bucket counts of the text) that its count exceeds.  A fingerprint is the hex string of
a length code (four steps for each doubling of the bytes) and of the bucket
codes, two to a digit.  Texts that share most triplets share most codes.

The difference of two fingerprints adds, per bucket, 0, 1, 2 or 6 for codes 0
to 3 apart, and STEP_WEIGHT for each length step beyond the first (at most
LENGTH_STEPS).  Likeness is 1 - difference / bound, not below 0.  The bound is
what unrelated texts of many triplets differ by (13 / 8 for each bucket), or less where both
texts are so short that they could not differ by that much.

Nulls: a null text counts as empty; the empty text has a fingerprint like any
other.  Texts under three bytes have no triplet: equal lengths are equal then.
Equal texts have equal fingerprints.  An empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusq.llm.arrow import extend, pieces, text_bytes
from corpusq.plans.scratch import shared_folder

BUCKETS = 256
#: The three bytes of each triplet, as places in the window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
MULTIPLIER = 2654435761
APART = np.array([0, 1, 2, 6])
STEP_WEIGHT, LENGTH_STEPS = 6, 12
#: Mean of APART over two independent, evenly spread codes, for all buckets.
BOUND = BUCKETS * 13 // 8

_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def length_code(sizes: np.ndarray) -> np.ndarray:
    """Four times the number of binary digits, plus the two digits after the first."""
    digits = np.frexp(sizes.astype(np.float64))[1].astype(np.int64)
    return 4 * digits + np.where(digits >= 3, (sizes >> np.maximum(digits - 3, 0)) & 3, 0)


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, BUCKETS) counts of the hashed triplets."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, sizes)
    counts = np.zeros((len(texts) + 1) * BUCKETS, dtype=np.int64)
    for shape, (i, j, k) in enumerate(TRIPLETS):
        n = len(data) - k
        if n <= 0:
            continue
        value = (data[i:i + n] << 16) | (data[j:j + n] << 8) | data[k:k + n]
        place = row[:n] + (((value + np.uint32(shape << 24)) * np.uint32(MULTIPLIER)) >> np.uint32(24))
        # the last k bytes of a text begin no triplet of this shape
        for back in range(1, k + 1):
            at = ends[sizes >= back] - back
            place[at[at < n]] = len(texts) * BUCKETS
        counts += np.bincount(place, minlength=len(counts))
    return counts[:-BUCKETS].reshape(-1, BUCKETS)


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length codes, (texts, BUCKETS) quartile codes)."""
    held = [np.zeros((0, BUCKETS), dtype=np.int8)]
    for low, high in pieces(texts):
        counts = bucket_counts(texts[low:high])
        at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
        quartiles = np.partition(counts, at, axis=1)[:, at]
        held.append((counts[:, None, :] > quartiles[:, :, None]).sum(axis=1).astype(np.int8))
    return length_code(np.array([len(t) for t in texts], dtype=np.int64)), np.concatenate(held)


def write_codes(lengths: np.ndarray, buckets: np.ndarray) -> list[str]:
    digits = np.concatenate([(lengths >> 4)[:, None], (lengths & 15)[:, None], 4 * buckets[:, 0::2] + buckets[:, 1::2]], axis=1)
    return [line.tobytes().decode() for line in _HEX[digits]]


def read_codes(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(len(fingerprints), -1)
    digits = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(fingerprints), -1)
    buckets = np.stack([digits[:, 2:] >> 2, digits[:, 2:] & 3], axis=2).reshape(len(fingerprints), -1)
    return packed[:, 0].astype(np.int64), buckets.astype(np.int8)


def likeness(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores 0 to 1 of fingerprints row by row; 1 for equal ones."""
    (la, a), (lb, b) = left, right
    steps = np.clip(np.abs(la - lb) - 1, 0, LENGTH_STEPS)
    difference = APART[np.abs(a - b)].sum(axis=1) + steps * STEP_WEIGHT
    bound = np.minimum(BOUND, APART[a].sum(axis=1) + APART[b].sum(axis=1))
    score = np.where(bound > 0, 1.0 - np.minimum(difference, bound) / np.maximum(bound, 1), 0.0)
    return np.where(difference == 0, 1.0, score)


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with a column fingerprint (one of that name is replaced); a narrow stage."""
    def factory():
        def compute(batch):
            found = [t or b"" for t in text_bytes(batch.column(batch.schema.get_field_index(text)))]
            return [pa.array(write_codes(*codes(found)), pa.string())]
        return compute
    return extend(docs, "fingerprint string", factory)


def compare_fingerprints(pairs: DataFrame, left: str, right: str, out: str = "likeness") -> DataFrame:
    """Pairs with the likeness of two fingerprint columns; null where either is null.  A narrow stage."""
    def factory():
        def compute(batch):
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (left, right))
            whole = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
            scores = [None] * len(a)
            if whole:
                found = likeness(read_codes([a[i] for i in whole]), read_codes([b[i] for i in whole]))
                for i, score in zip(whole, found.tolist()):
                    scores[i] = score
            return [pa.array(scores, pa.float64())]
        return compute
    return extend(pairs, f"`{out}` double", factory)


# ---- edited by the next document ----------------------------------------------------------------
EDITED = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_text(text: str, after: str, share: int = 4) -> str:
    """The last 1 / share of the code points replaced by the first as many (or all) of another text."""
    cut = len(text) // share
    return text[:len(text) - cut] + after[:cut]


def _measure(texts: list[str], share: int) -> list[pa.Array]:
    """Columns EDITED of each text but the last, whose successor is the next in the list."""
    lengths, buckets = codes([t.encode() for t in texts])
    made = [edited_text(a, b, share).encode() for a, b in zip(texts, texts[1:])]
    own, after, changed = (lengths[:-1], buckets[:-1]), (lengths[1:], buckets[1:]), codes(made)
    return [pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in made], pa.string()),
            pa.array(write_codes(*own), pa.string()), pa.array(write_codes(*changed), pa.string()),
            pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, after), pa.float64())]


def edit_by_next(docs: DataFrame, share: int = 4) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    The next document is the following row by (doc_id, text hash, text), null
    ids first; the first row follows the last, so a single row follows itself.
    Rows with one id are rows of their own.  Texts are shuffled once, into ranges of
    the order; a task streams its range and holds two rows at a time beside its
    batch.  The last row of each range waits for the first of the next one: two
    rows per range, joined by range number.
    """
    spark = docs.sparkSession
    order = ["doc_id", "_hash", "text"]
    ranged = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
              .repartitionByRange("doc_id", "_hash").sortWithinPartitions(*order)
              .select("doc_id", "text", F.spark_partition_id().alias("part")))
    key = ranged.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, {EDITED}, kind string, part int, text string"
    names = ["doc_id", *[f.split()[0] for f in EDITED.split(", ")], "kind", "part", "text"]

    def rows(ids, measured, kind, part, texts=None):
        n = len(ids)
        arrays = measured or [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays(
            [ids, *arrays, pa.array([kind] * n), pa.array([part] * n, pa.int32()), pa.array(texts or [None] * n, pa.string())], names=names)

    def follow(batches):
        held = part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if held is None:
                part = batch.column(2)[0].as_py()
                yield rows(ids.slice(0, 1), None, "head", part, texts[:1])
            else:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            for low, high in pieces(texts[:-1]):
                yield rows(ids.slice(low, high - low), _measure(texts[low:high + 1], share), "done", part)
            held = pa.concat_arrays([ids.slice(len(ids) - 1, 1)]), texts[-1]
        if held is not None:
            yield rows(held[0], None, "last", part, [held[1]])

    def finish(batches):
        for batch in batches:
            for i, (text, after) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                yield rows(batch.column(0).slice(i, 1), _measure([text, after], share), "done", batch.column(1)[i].as_py())
    path = shared_folder(spark, "edited")
    ranged.mapInArrow(follow, schema).write.parquet(path)
    made = spark.read.schema(schema).parquet(path)
    heads = made.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    every = Window.orderBy("part")
    following = heads.select(F.col("next_part").alias("part")).select(  # one number per range
        "part", F.coalesce(F.lead("part").over(every), F.min("part").over(Window.orderBy(F.lit(0)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    last = (made.filter("kind = 'last'").select("doc_id", "part", "text").join(following, "part").join(heads, "next_part")
            .select("doc_id", "part", "text", "after"))
    wanted = names[:7]
    return made.filter("kind = 'done'").select(*wanted).unionByName(last.mapInArrow(finish, schema).select(*wanted))
