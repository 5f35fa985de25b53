"""Byte-balanced shards by Karmarkar-Karp differencing of indivisible groups.

Documents with equal texts form a group that stays together.  Groups above the
grain (total bytes / (shards * GRAIN)) are items of their own; there are fewer
than shards * GRAIN of them.  Smaller groups are gathered by hash into shards *
GRAIN items.  Differencing runs over these items, at most 2 * shards * GRAIN at
any input size: it takes the two partial partitions with the largest spread
again and again and adds them in opposite order.

Nulls: a null text has no bytes, crc32 0 and shares the group of the empty
text.  Repeated rows each get a slot.  An empty table gives an empty result.
Other columns are kept whatever their names; one named like a result comes as own_<name>.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusq.llm.columns import OWN, hold, release
from corpusq.plans.scratch import shared_folder

SHARDS = 24
GRAIN = 200
ROW_BYTES = 8
#: Rows numbered by one task; a shard is numbered in as many chunks as it needs.
CHUNK_ROWS = 200_000


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item by largest differencing; ties go by item position."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    parts, merged = {}, []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(shards, dtype=np.int64)
        sums[0] = size
        parts[i] = sums
        heap.append((-size, i))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = parts.pop(a) + parts.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        merged.append((a, b, order))
        parts[made] = total
        heapq.heappush(heap, (-int(total[0]), made))
        made += 1
    places = {made - 1: np.arange(shards)}
    for at in range(len(merged) - 1, -1, -1):
        a, b, order = merged[at]
        to = places.pop(n + at)
        left, right = np.empty(shards, dtype=np.int64), np.empty(shards, dtype=np.int64)
        left[order] = to
        right[shards - 1 - order] = to
        places[a], places[b] = left, right
    return np.array([places[i][0] for i in range(n)], dtype=np.int32)


def text_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + F.lit(ROW_BYTES)


def _group(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def item_shards(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """(own, bundle, group_id, shard): one row per item, at most 2 * shards * grain rows."""
    spark = docs.sparkSession
    buckets = shards * grain
    total = docs.agg(F.sum(text_size())).first()[0] or 0
    groups = docs.select(_group().alias("group_id"), text_size().alias("bytes")).groupBy("group_id").agg(F.sum("bytes").alias("bytes"))
    own = F.col("bytes") * buckets > F.lit(total)
    items = (groups.withColumn("own", own)
             .withColumn("bundle", F.when(~own, F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("int")))
             .withColumn("group_id", F.when(own, F.col("group_id")))
             .groupBy("own", "bundle", "group_id").agg(F.sum("bytes").alias("bytes")))

    def balance(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables).sort_by([("bytes", "descending"), ("group_id", "ascending"), ("bundle", "ascending")])
        shard = difference(table.column("bytes").to_numpy(), shards)
        yield from table.drop_columns(["bytes"]).append_column("shard", pa.array(shard, pa.int32())).to_batches()
    path = shared_folder(spark, "shard-items")
    items.repartition(1).mapInArrow(balance, "own boolean, bundle int, group_id binary, shard int").write.parquet(path)
    return spark.read.parquet(path)


def number_rows(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within each group; a group is numbered in chunks of about CHUNK_ROWS rows."""
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    cut = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    counts = cut.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_chunk").orderBy(*order)
    return (cut.withColumn("_inside", F.row_number().over(inside)).join(offsets, [group, "_chunk"])
            .withColumn(out, (F.col("_inside") - 1 + F.col("_offset")).cast("bigint"))
            .drop("_inside", "_chunk", "_offset"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN, keep: list[str] | None = None) -> DataFrame:
    """Documents with size, text_crc32, shard and slot.  ``keep`` limits the other columns that are carried along."""
    spark = docs.sparkSession
    added = ["size", "text_crc32", "shard", "slot"]
    keep = docs.columns if keep is None else keep
    need = [c for c in ("doc_id", "text") if c == "doc_id" or c in keep]
    items = item_shards(docs, shards, grain)
    large = F.broadcast(items.filter("own").select("group_id", F.col("shard").alias("_own_shard")))
    small = F.broadcast(items.filter("not own").select("bundle", F.col("shard").alias("_bundle_shard")))
    carried = hold(docs.select("doc_id", "text", *[F.col(f"`{c}`") for c in keep if c not in ("doc_id", "text")]), ["doc_id", "text"])
    placed = (carried.select(*need, OWN, text_size().alias("size"),
                             F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"),
                             _group().alias("group_id"))
              .withColumn("bundle", F.pmod(F.xxhash64("group_id"), F.lit(shards * grain)).cast("int"))
              .join(large, "group_id", "left").join(small, "bundle", "left")
              .withColumn("shard", F.coalesce("_own_shard", "_bundle_shard"))
              .drop("_own_shard", "_bundle_shard", "bundle"))
    path = shared_folder(spark, "shard-rows")
    placed.write.parquet(path)
    numbered = number_rows(spark.read.parquet(path), "shard", ["doc_id", "group_id"], "slot")
    return release(numbered, keep, need, added)


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder per shard; a shard may be written by several tasks."""
    sharded.repartition(F.col("shard"), F.floor(F.col("slot") / CHUNK_ROWS)).write.partitionBy("shard").parquet(path)
