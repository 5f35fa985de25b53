"""Content search over a stored corpus that skips what cannot match.

Documents lie in blocks by the hash of their path.  Beside each block lies a
signature: one bit for every hashed group of three bytes that a file name or text
of the block holds, lower-cased.  A search reads the signatures, then only the
blocks that hold all groups of the term, and looks there with the exact test.
A term that is rare in letters reads few blocks; one shorter than three bytes reads
all.  Pages are asked for by the last path of the page before, so no page
is counted off from the start.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusq.functions.text import file_name
from corpusq.plans.bounded import small_rows

BLOCK_ROWS, MAX_BLOCKS = 2000, 4096
#: Bits of a signature; a block of more text than that many distinct groups is seldom skipped.
BITS = 1 << 18
#: Bytes whose groups are hashed at once.
PIECE_BYTES = 4 << 20


def _bits(data: bytes) -> np.ndarray:
    """Places of the byte triplets, repeated ones included."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    triplet = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) > 2 else np.zeros(0, dtype=np.uint32)
    return ((triplet * np.uint32(2654435761)) >> np.uint32(32 - BITS.bit_length() + 1)).astype(np.int64)


def _pieces(data: bytes):
    """Overlapping pieces of a long text, so that no triplet is cut."""
    for low in range(0, max(len(data) - 2, 1), PIECE_BYTES):
        yield data[low:low + PIECE_BYTES + 2]


def write_search_store(docs: DataFrame, path: str, key: str = "doc_path", text: str = "text", block_rows: int = BLOCK_ROWS) -> None:
    """Store documents by block under ``path``, and the signature of each block beside them."""
    spark = docs.sparkSession
    blocks = min(MAX_BLOCKS, max(1, -(-docs.count() // block_rows)))
    placed = docs.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    placed.repartition("block", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4))).sortWithinPartitions("block", key).write.partitionBy(
        "block").parquet(f"{path}/docs")
    stored = spark.read.parquet(f"{path}/docs").select("block", F.lower(file_name(key)).alias("name"), F.lower(F.col(text)).alias("low"))

    def sign(batches):
        seen = {}
        for batch in batches:
            for block, *fields in zip(*[batch.column(i).cast(pa.int32() if i == 0 else pa.binary()).to_pylist() for i in range(3)]):
                marks = seen.setdefault(block, np.zeros(BITS, dtype=bool))
                for data in fields:
                    for piece in _pieces(data or b""):
                        marks[_bits(piece)] = True
        for block, marks in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(marks).tobytes()])], names=["block", "marks"])

    def unite(table: pa.Table) -> pa.Table:
        marks = np.bitwise_or.reduce([np.frombuffer(m, dtype=np.uint8) for m in table.column("marks").to_pylist()])
        return pa.table({"block": table.column("block").slice(0, 1), "marks": pa.array([marks.tobytes()])})
    schema = "block int, marks binary"
    stored.mapInArrow(sign, schema).groupBy("block").applyInArrow(unite, schema).write.parquet(f"{path}/signatures")


def candidate_blocks(spark: SparkSession, path: str, term: str) -> list[int] | None:
    """Blocks that may hold the term, None for all; at most MAX_BLOCKS numbers."""
    wanted = np.unique(_bits(term.lower().encode()))
    if not len(wanted):
        return None

    def has(marks: pa.Array) -> pa.Array:
        return pa.array([bool(np.unpackbits(np.frombuffer(m, dtype=np.uint8))[wanted].all()) for m in marks.to_pylist()], pa.bool_())
    rows = small_rows(spark.read.parquet(f"{path}/signatures").filter(F.arrow_udf(has, "boolean")(F.col("marks"))).select("block"), MAX_BLOCKS)
    return sorted(r["block"] for r in rows)


def search_store(spark: SparkSession, path: str, query: str, after: str | None = None, page_size: int = 20, key: str = "doc_path",
                 text: str = "text", where: Column | None = None) -> DataFrame:
    """(key, filename, match_type): the next page of documents whose file name, else content, contains the query, by path."""
    wanted = query.lower()
    blocks = candidate_blocks(spark, path, wanted)
    scope = spark.read.parquet(f"{path}/docs")
    if blocks is not None:
        scope = scope.filter(F.col("block").isin(blocks))
    if after is not None:
        scope = scope.filter(F.col(key) > after)
    if where is not None:
        scope = scope.filter(where)
    scope = scope.withColumn("filename", file_name(key))
    kind = F.when(F.contains(F.lower("filename"), F.lit(wanted)), "filename").when(F.contains(F.lower(F.col(text)), F.lit(wanted)), "content")
    return (scope.withColumn("match_type", F.lit("filename") if not wanted else kind).filter(F.col("match_type").isNotNull())
            .select(key, "filename", "match_type").orderBy(key).limit(page_size))
