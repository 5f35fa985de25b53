"""Ordered windows over groups of any size.

A plain window sends a whole group to one task.  Here a group is cut into
ranges of its integer position, so that a group holding a third of all rows is
spread over many tasks: the window runs inside (group, range) and one small row
per range carries the state across the borders.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

RANGE = 65536


def _ranged(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(pos) / F.lit(width)))


def _with_borders(rows: DataFrame, borders: DataFrame, group: list[str]) -> DataFrame:
    """Equality join on (group, range) in which a missing key equals a missing key, so no row is lost."""
    keys = [*group, "_range"]
    renamed = borders.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in borders.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)])
    return rows.join(renamed, same).drop(*[f"_k{i}" for i in range(len(keys))])


def neighbours(df: DataFrame, group: list[str], pos: str, values: list[str], width: int = RANGE) -> DataFrame:
    """Add prev_<v> and next_<v> for each value, in position order within the group."""
    ranged = _ranged(df, pos, width)
    inner = Window.partitionBy(*group, "_range").orderBy(pos)
    outer = Window.partitionBy(*group).orderBy("_range")
    packed = F.struct(*values)
    rows = (ranged.withColumn("_prev", F.lag(packed).over(inner))
                  .withColumn("_next", F.lead(packed).over(inner)))
    borders = (ranged.groupBy(*group, "_range")
               .agg(F.min_by(packed, pos).alias("_first"), F.max_by(packed, pos).alias("_last"))
               .select(*group, "_range",
                       F.lag("_last").over(outer).alias("_before"),
                       F.lead("_first").over(outer).alias("_after")))
    joined = _with_borders(rows, borders, group)
    joined = (joined.withColumn("_prev", F.coalesce("_prev", "_before"))
                    .withColumn("_next", F.coalesce("_next", "_after")))
    out = joined.select(*df.columns,
                        *[F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values],
                        *[F.col(f"_next.{v}").alias(f"next_{v}") for v in values])
    return out


def running_sum(df: DataFrame, group: list[str], pos: str, value: str, out: str, width: int = RANGE) -> DataFrame:
    """Inclusive running sum of ``value`` in position order within the group."""
    ranged = _ranged(df, pos, width)
    inner = (Window.partitionBy(*group, "_range").orderBy(pos)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outer = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
              .select(*group, "_range", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_offset")))
    return (_with_borders(ranged.withColumn("_inner", F.sum(value).over(inner)), totals, group)
            .select(*df.columns, (F.col("_inner") + F.col("_offset")).alias(out)))


def floored_sum(df: DataFrame, group: list[str], pos: str, value: str, out: str, width: int = RANGE) -> DataFrame:
    """Inclusive running sum that never falls below zero: each step is max(0, sum before + ``value``).

    The floored sum is the running sum minus its lowest value so far, if that is
    below zero.  (total, lowest) of two neighbouring runs combine to that of both,
    so one row per range carries the state and no group is walked by one task.
    """
    ranged = _ranged(df, pos, width)
    inner = (Window.partitionBy(*group, "_range").orderBy(pos)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outer = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    rows = (ranged.withColumn("_inner", F.sum(value).over(inner))
            .withColumn("_inner_low", F.min("_inner").over(inner)))
    ends = (rows.groupBy(*group, "_range").agg(F.sum(value).alias("_total"), F.min("_inner").alias("_lowest"))
            .withColumn("_offset", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
            .withColumn("_low", F.coalesce(F.min(F.col("_offset") + F.col("_lowest")).over(outer), F.lit(0)))
            .select(*group, "_range", "_offset", "_low"))
    total, low = F.col("_inner") + F.col("_offset"), F.col("_inner_low") + F.col("_offset")
    return (_with_borders(rows, ends, group)
            .select(*df.columns, (total - F.least(F.lit(0), "_low", low)).alias(out)))


def last_value(df: DataFrame, group: list[str], pos: str, values: dict, width: int = RANGE) -> DataFrame:
    """Most recent non-null value up to and including the row, for each ``{out: Column}``."""
    named = _ranged(df, pos, width)
    for out, column in values.items():
        named = named.withColumn(out, column)
    inner = (Window.partitionBy(*group, "_range").orderBy(pos)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outer = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    borders = named.groupBy(*group, "_range").agg(
        *[F.max_by(out, F.when(F.col(out).isNotNull(), F.col(pos))).alias(f"_b_{out}") for out in values])
    borders = borders.select(*group, "_range", *[
        F.last(f"_b_{out}", ignorenulls=True).over(outer).alias(f"_b_{out}") for out in values])
    rows = named.select(*df.columns, "_range", *[
        F.last(out, ignorenulls=True).over(inner).alias(out) for out in values])
    return _with_borders(rows, borders, group).select(
        *df.columns, *[F.coalesce(out, f"_b_{out}").alias(out) for out in values])


def top_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group.

    The rank filter becomes a window group limit, so each map task keeps at most
    k rows of a group before the shuffle and a hot group never reaches one task whole.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
