"""Mix sources to target weights with DataFrame operations only.

Words are summed per source, targets share the total by weight and stop at
``most`` times their source's size (the excess is reshared by weight until none
is above), the repetition rate of a source is target / size, and a document is
emitted floor(rate) times plus one copy when a number derived from the hash of
its id is below the fraction of the rate.

Nulls: a null text has size 0; a null source is a source of its own, ordered
last; a null id takes the hash of the word "null".  Rows with one id take the same decision.
A source without words has target 0 and rate 0.  An empty table gives an empty
result.  ``mix`` returns the documents' own columns untouched whatever their
names; in ``mixing_plan`` columns named like a result are replaced.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusq.llm.columns import hold, release
from corpusq.plans.scratch import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: Sources whose rates may be broadcast; with more, the join shuffles and splits hot sources.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: str = SEED) -> Column:
    """Number in [0, 1) from the hash of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target, rate), one row per source.

    Sources are ordered by limit over weight; those whose limit lies below the
    common level are held at their limit.  The windows run over one row per source.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count()).alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(listed, (F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    open_weight = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - held).cast("double") / open_weight
    limit = (F.col("source_size") * most).cast("double")
    # the level is the first one that the limit of its own source does not undercut
    tried = (ranked.withColumn("_level", level).withColumn("_limit", limit).withColumn("_rank", F.row_number().over(ordered))
             .withColumn("_common", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.struct(
                 F.col("_rank").alias("at"), F.col("_level").alias("level")))).over(everything)))
    target = F.least("_limit", F.col("_common.level") * F.col("weight"))
    return (tried.withColumn("target", F.coalesce(target, F.lit(0.0)))
            .select("source", "source_size", "weight", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")))


def mixing_plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Documents with size, source_size, target, rate and copies."""
    spark = docs.sparkSession
    path = shared_folder(spark, "mixing-rates")
    source_rates(docs, weights, most).write.parquet(path)
    rates = spark.read.parquet(path)
    rates = rates.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    base = docs.drop("source_size", "target", "rate", "copies", "size", "_source")
    return (base.join(rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("copies", F.floor("rate") + F.when(
                uniform(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0))
            .withColumn("size", word_count()))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with."""
    need = ["doc_id", "source", "text"]
    plan = mixing_plan(hold(docs, need), weights, most, seed).filter("copies > 0")
    return release(plan.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))), docs.columns, need)
