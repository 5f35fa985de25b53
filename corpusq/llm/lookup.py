"""Centroid clustering of integer vectors with scalar lookup tables.

A component x becomes floor(256 x).  In each round a task tabulates, for every
dimension, the squared difference between each integer value that occurs in its
block and each centroid; the distances of the block are gathers from these
tables and their sums.  Tasks send one partial sum per centroid and dimension,
so what is shuffled does not depend on the number of vectors, a centroid that
holds most vectors is no hot key, and the driver sees centroids only.  All sums
are exact integers.

Kept are vectors with as many components as asked for, none null or not finite.
A component beyond +-LARGEST / 256 is held at that bound, because a long could
not hold its squared distances.  Repeated rows are vectors of their own.  A null id draws as the
word "null"; equal draws go by the vector.  With fewer vectors than centroids
every vector starts one.  An empty table, or one without a kept vector, gives an
empty result.  Other columns are not carried along.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusq.plans.scratch import shared_folder

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Largest integer component: DIM squared differences of twice this still fit a long.
LARGEST = 180_000_000
#: Vectors whose distances are computed at once.
BLOCK_ROWS = 4096
#: Value ranges up to this width are numbered by a presence map, wider ones by sorting.
MAP_WIDTH = 1 << 16
_LONGEST = 2 ** 63 - 1


def integer_vectors(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(key, v) with v the integer components of the kept vectors, a narrow stage."""
    source = vectors.select(F.col(key), F.col(value).cast("array<double>").alias("v"))
    schema = source.select(key, F.lit(None).cast("array<int>").alias("v")).schema

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            fits = np.array(lists.value_lengths().fill_null(-1)) == dim
            some = batch.filter(pa.array(fits))
            numbers = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null becomes NaN
            sound = np.isfinite(numbers).all(axis=1)
            whole = np.clip(np.floor(numbers[sound] * scale), -LARGEST, LARGEST).astype(np.int32)
            ends = pa.array(np.arange(len(whole) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [some.column(0).filter(pa.array(sound)), pa.ListArray.from_arrays(ends, pa.array(whole.ravel()))], names=schema.names)
    return source.mapInArrow(run, schema)


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, number of each entry's value)."""
    low, high = int(column.min()), int(column.max())
    if high - low >= MAP_WIDTH:
        return np.unique(column, return_inverse=True)
    present = np.zeros(high - low + 1, dtype=np.int64)
    present[column - low] = 1
    values = np.flatnonzero(present) + low
    return values, (np.cumsum(present) - 1)[column - low]


def distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centroids) as sums of gathers from one table per dimension."""
    total = np.zeros((len(block), len(centroids)), dtype=np.int64)
    for d in range(block.shape[1]):
        values, number = occurring(block[:, d])
        table = np.square(values.astype(np.int64)[:, None] - centroids[None, :, d])
        total += table[number]
    return total


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance); ties go to the smaller number."""
    far = distances(block, centroids)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(block)), best]


def _blocks(batches, dim):
    for batch in batches:
        whole = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dim)
        for low in range(0, len(whole), BLOCK_ROWS):
            yield batch.column(0).slice(low, BLOCK_ROWS), whole[low:low + BLOCK_ROWS]


def first_centroids(vectors: DataFrame, key: str = "vec_id", dim: int = DIM, count: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in ascending hash order; at most ``count`` rows leave the plan."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), dim)


def moved_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floors of the means of the vectors nearest to each centroid; one without vectors stays."""
    count, dim = centroids.shape

    def run(batches):
        sums, sizes = np.zeros((count, dim), dtype=np.int64), np.zeros(count, dtype=np.int64)
        for _, block in _blocks(batches, dim):
            best, _ = nearest(block, centroids)
            order = np.argsort(best, kind="stable")
            held, at = np.unique(best[order], return_index=True)
            sums[held] += np.add.reduceat(block[order], at, axis=0)
            sizes += np.bincount(best, minlength=count)
        held = np.flatnonzero(sizes)
        ends = pa.array(np.arange(len(held) + 1) * dim, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(sums[held].ravel())), pa.array(sizes[held])],
            names=["cluster", "sums", "size"])
    parts = vectors.mapInArrow(run, "cluster int, sums array<bigint>, size bigint")
    # sums of sums are decimals: no table is too long for them
    totals = (parts.select("cluster", "size", F.posexplode("sums").alias("d", "part"))
              .groupBy("cluster", "d").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"), F.sum("size").alias("size")))
    moved = centroids.copy()
    for row in totals.collect():  # at most count x dim rows
        moved[row["cluster"], row["d"]] = int(row["sum"]) // row["size"]
    return moved


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", dim: int = DIM, count: int = CENTROIDS,
                    rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) per kept vector after ``rounds`` rounds, the centroids themselves)."""
    spark = vectors.sparkSession
    path = shared_folder(spark, "integer-vectors")
    integer_vectors(vectors, key, value, dim).write.parquet(path)
    kept = spark.read.parquet(path)
    centroids = first_centroids(kept, key, dim, count, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved_centroids(kept, centroids)

    def run(batches):
        for keys, block in _blocks(batches, dim):
            best, far = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays([keys, pa.array(best, pa.int32()), pa.array(far, pa.int64())],
                                             names=[key, "cluster", "distance"])
    schema = kept.select(key, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance")).schema
    path = shared_folder(spark, "clusters")
    kept.mapInArrow(run, schema).write.parquet(path)
    return spark.read.parquet(path), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assigned vectors with cluster_inertia, inertia and centroid_sha256; the table joined has one row per centroid.

    Sums are exact; one beyond the largest long is given as the largest long.
    """
    spark = assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    far = F.col("distance").cast("decimal(38,0)")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(far).alias("s")).collect()}  # a row per centroid
    total = min(sum(sums.values()), _LONGEST)
    rows = [(i, min(sums.get(i, 0), _LONGEST), total, digest) for i, digest in digests]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")
