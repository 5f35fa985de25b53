"""Nearest neighbours over a stored corpus, by cells of a coarse quantiser.

``build_index`` groups vectors by direction (spherical k-means, one job per
round) and stores them partitioned by cell.  ``search_index`` sends each query
to its nearest cells only and ranks exactly inside them, so a search costs
queries x probes, not queries x blocks, and reads the probed cells' files.
How many cells are probed is not a guess: a sample of the queries is answered
by the exact scan as well, and the probes double until the mean recall of
the sample reaches what is asked; at all cells the search is the exact one.

Cells may differ in size as they like: a cell's vectors are cut into chunks
and its queries into blocks of bounded size, each pair a task's group.

A null, empty or zero vector is in no cell: it finds nothing and nobody finds it.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusq.plans import vectors as V
from corpusq.plans.ordered import top_k
from corpusq.plans.scratch import shared_folder

MAX_CELLS = 4096
#: Rows the quantiser is fitted on, in expectation; every row is assigned and stored.
FIT_ROWS = 200_000
ROUNDS = 8
#: Vectors and queries that one group holds, in expectation.
CHUNK_ROWS, QUERY_ROWS = 50_000, 50_000
#: Queries of the recall audit.
AUDIT_QUERIES = 64


def _directed(df: DataFrame, vec: str) -> DataFrame:
    return df.filter(F.exists(vec, lambda x: x != 0))


def _thin(df: DataFrame, key: str, rows: int) -> DataFrame:
    total = df.count()
    place = F.xxhash64(F.lit("fit"), F.col(key)).bitwiseAND(F.lit(2 ** 63 - 1))
    return df if total <= rows else df.filter(place < F.lit(int(rows / total * 2 ** 63)))


def _nearest_cells(batch_column, centroids: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) numbers of the nearest cells, nearest first."""
    near = V._unit(V._dense(batch_column)) @ centroids.T
    if count < near.shape[1]:
        some = np.argpartition(-near, count - 1, axis=1)[:, :count]
    else:
        some = np.broadcast_to(np.arange(near.shape[1]), near.shape)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype(np.int32)


def fit_cells(vectors: DataFrame, cells: int, key: str, vec: str, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Unit centroids (cells, dim); each round sends one partial sum per task and cell."""
    sample = _thin(_directed(vectors.select(key, vec), vec), key, fit_rows).cache()
    first = sample.orderBy(F.xxhash64(F.lit("cell"), F.col(key))).limit(cells).collect()  # at most MAX_CELLS rows
    centroids = V._unit(np.array([r[vec] for r in first], dtype=np.float64)) if first else np.zeros((0, 0))

    def partial(held):
        def run(batches):
            sums = np.zeros_like(held)
            counts = np.zeros(len(held), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    best = _nearest_cells(batch.column(0), held, 1)[:, 0]
                    np.add.at(sums, best, V._unit(V._dense(batch.column(0))))
                    counts += np.bincount(best, minlength=len(held))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(sums[used]), pa.list_(pa.float64()))],
                                             names=["cell", "sums"])
        return run
    for _ in range(rounds if len(centroids) > 1 else 0):
        parts = sample.select(vec).mapInArrow(partial(centroids), "cell int, sums array<double>")
        totals = (parts.select("cell", F.posexplode("sums").alias("d", "x")).groupBy("cell", "d").agg(F.sum("x").alias("x"))
                  .groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("sums")))
        moved = centroids.copy()
        for row in totals.collect():  # one row per cell
            length = math.sqrt(sum(x * x for x in row["sums"]))
            if length:
                moved[row["cell"]] = np.array(row["sums"]) / length
        if np.allclose(moved, centroids):
            break
        centroids = moved
    sample.unpersist()
    return centroids


def build_index(vectors: DataFrame, path: str, key: str = "chunk_id", vec: str = "embedding", columns: tuple[str, ...] = (),
                cells: int | None = None, chunk_rows: int = CHUNK_ROWS) -> None:
    """Store (key, vec, columns) under ``path``, partitioned by cell, beside the cells' centroids.

    ``columns`` are what searches may filter by; rows lie ordered by them inside
    a file, so its statistics let a filtered search skip row groups.
    """
    spark = vectors.sparkSession
    kept = _directed(vectors.select(key, vec, *columns), vec)
    cells = cells or min(MAX_CELLS, max(1, math.isqrt(kept.count())))
    centroids = fit_cells(kept, cells, key, vec)
    placed_schema = spark.createDataFrame([], kept.schema).withColumn("cell", F.lit(0)).schema

    def place(batches):
        for batch in batches:
            cell = _nearest_cells(batch.column(1), centroids, 1)[:, 0] if batch.num_rows else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=placed_schema.names)
    placed = kept.mapInArrow(place, placed_schema)
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    about = {r["cell"]: r["n"] for r in sizes.collect()}  # one row per cell
    rows = [(i, c, about.get(i, 0), max(1, -(-about.get(i, 0) // chunk_rows))) for i, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(rows, "cell int, centroid array<double>, n bigint, chunks int")
    facts.coalesce(1).write.parquet(f"{path}/cells")
    (placed.join(F.broadcast(facts.select("cell", "chunks")), "cell")
     .withColumn("part", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int")).drop("chunks")
     .repartition("cell", "part").sortWithinPartitions("cell", "part", *columns)
     .write.partitionBy("cell").parquet(f"{path}/vectors"))


def _read_cells(spark: SparkSession, path: str):
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # one row per cell
    return np.array([r["centroid"] for r in rows], dtype=np.float64), {r["cell"]: (r["n"], r["chunks"]) for r in rows}


def _joined_chunks(rows: int, chunks: int) -> int:
    """How many of a cell's stored chunks a search takes as one: queries are repeated once per group of chunks."""
    return max(1, CHUNK_ROWS * chunks // max(1, rows))


def probe_index(queries: DataFrame, path: str, k: int, probes: int, key: str = "question_id", chunk: str = "chunk_id",
                query_vec: str = "query_embedding", vec: str = "embedding", where: dict | None = None,
                per_query: dict | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(key, chunk, distance, rank) of the k nearest vectors in the ``probes`` nearest cells of each query."""
    spark = queries.sparkSession
    centroids, sizes = _read_cells(spark, path)
    per_query = per_query or {}
    stored = spark.read.parquet(f"{path}/vectors") if len(centroids) else None
    asked = queries.select(key, query_vec, *[F.col(q).alias(c) for c, q in per_query.items()])
    directed = _directed(asked, query_vec)
    if stored is None:
        return queries.select(key, F.lit(None).cast("string").alias(chunk), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    probed_schema = spark.createDataFrame([], directed.schema).withColumn("_cells", F.array(F.lit(0))).schema

    def probe(batches):
        for batch in batches:
            cells = _nearest_cells(batch.column(1), centroids, probes) if batch.num_rows else np.zeros((0, 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=probed_schema.names)
    sent = directed.mapInArrow(probe, probed_schema).select("*", F.explode("_cells").alias("cell")).drop("_cells")
    crowds = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}  # one row per cell
    joined = {c: _joined_chunks(*sizes[c]) for c in crowds}
    facts = F.broadcast(spark.createDataFrame([(c, joined[c], -(-sizes[c][1] // joined[c]), -(-n // query_rows)) for c, n in crowds.items()],
                                              "cell int, _joined int, _chunks int, _blocks int"))
    left = (sent.join(facts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
            .withColumn("_qb", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).drop("_joined", "_chunks", "_blocks"))
    scope = stored.filter(F.col("cell").isin(list(crowds)))  # other cells' files are not listed
    for column, value in (where or {}).items():
        scope = scope.filter(F.col(column) == value)
    right = (scope.select(chunk, vec, *per_query, "cell", "part").join(facts, "cell")
             .withColumn("part", F.floor(F.col("part") / F.col("_joined")).cast("int"))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_joined", "_chunks", "_blocks"))
    schema, ddl = V._types(queries, stored, key, chunk)
    score = V.cell_scorer(k, key, chunk, query_vec, vec, list(per_query), schema)
    group = ["cell", "part", "_qb"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(score, ddl)
    return top_k(found, [key], [F.col("distance").asc_nulls_last(), F.col(chunk)], k)


def audited_probes(queries: DataFrame, path: str, k: int, recall: float, audit: int, key: str, chunk: str, query_vec: str, vec: str,
                   where: dict | None, per_query: dict | None) -> int:
    """Smallest tried number of probes at which the audited queries reach the mean recall."""
    spark = queries.sparkSession
    centroids, _ = _read_cells(spark, path)
    total = max(1, len(centroids))
    asked = _directed(queries, query_vec)
    if asked.count() > audit:
        asked = asked.orderBy(F.xxhash64(F.lit("audit"), F.col(key))).limit(audit)
    sample = _written(asked, "audit")
    stored = spark.read.parquet(f"{path}/vectors") if len(centroids) else None
    if stored is None:
        return total
    for column, value in (where or {}).items():
        stored = stored.filter(F.col(column) == value)
    per_query = per_query or {}
    asked = sample.select(key, query_vec, *[F.col(q).alias(c) for c, q in per_query.items()])
    exact = _written(V.nearest(asked, stored, k, key, chunk, query_vec, vec, list(per_query)).select(key, chunk), "exact")
    if exact.isEmpty():
        return 1
    wanted = exact.groupBy(key).agg(F.count(F.lit(1)).alias("_wanted"))
    probes = max(1, total // 32)
    while probes < total:
        found = probe_index(sample, path, k, probes, key, chunk, query_vec, vec, where, per_query).select(key, chunk)
        met = exact.join(found, [key, chunk], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_met"))
        share = F.coalesce("_met", F.lit(0)) / F.col("_wanted")
        if wanted.join(met, key, "left").agg(F.avg(share)).first()[0] >= recall:
            return probes
        probes *= 2
    return total


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, stored once for the rounds of the audit; none of them pass through the driver."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def search_index(queries: DataFrame, path: str, k: int = 5, recall: float = 0.95, audit: int = AUDIT_QUERIES, key: str = "question_id",
                 chunk: str = "chunk_id", query_vec: str = "query_embedding", vec: str = "embedding", where: dict | None = None,
                 per_query: dict | None = None) -> DataFrame:
    """(key, chunk, distance, rank) of the k nearest stored vectors, at the audited recall.

    ``where`` {stored column: value} and ``per_query`` {stored column: query column} as in ``knn``.
    """
    probes = audited_probes(queries, path, k, recall, audit, key, chunk, query_vec, vec, where, per_query)
    return probe_index(queries, path, k, probes, key, chunk, query_vec, vec, where, per_query)
