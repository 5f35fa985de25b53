"""Connected components of a large undirected graph by alternating large-star and small-star rounds.

Every round is two slim shuffles written to the shared folder; a hub is
pre-aggregated to its smallest neighbour before the shuffle, and its edges are
split by the adaptive skew join.  Nothing but counters reaches the driver.
"""

from pyspark.sql import DataFrame, functions as F

from corpusq.plans.scratch import shared_folder


def _smallest(directed: DataFrame) -> DataFrame:
    return directed.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = both.join(_smallest(both), "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    near = _smallest(down)
    small = (down.join(near, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .union(near.filter("a <> m").select("a", F.col("m").alias("b"))))
    return small.distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) for every vertex that has an edge; root is the smallest id of its component."""
    spark = edges.sparkSession
    current = (edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        path = shared_folder(spark, "components")
        current.write.parquet(path)
        current = spark.read.parquet(path)
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if before is not None and tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        current = _round(current)
    # at rest every vertex points at the root of its component
    return current.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
