"""Child rows under a key: in long form, nested, or nested in parts where the caller sets a limit.

The shape never depends on the number of children.  The long form has one row
per child and gathers nothing, so no key is too large for it.  ``nest`` gives
one row per key with all its children, which one task must hold.  Only a call
with a ``limit`` gets parts.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a key from which a salted join spreads it.
HOT_ROWS = 100_000


def with_part(children: DataFrame, keys: list[str], pos: str, limit: int) -> DataFrame:
    """Add ``part``: 0, or the position range for keys with more than ``limit`` rows.

    The list of large keys has at most rows / limit entries.
    """
    large = (children.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > limit).select(*keys, F.lit(True).alias("_large")))
    return (children.join(large, keys, "left")
            .withColumn("part", F.when(F.col("_large"), F.floor(F.col(pos) / F.lit(limit)))
                        .otherwise(F.lit(0)).cast("long"))
            .drop("_large"))


def _position(pos: str, order: list | None) -> Column:
    return F.struct(*(order or [F.col(pos)]), F.col(pos).alias("_pos"))


def long_form(children: DataFrame, keys: list[str], pos: str, item: Column, order: list | None = None) -> DataFrame:
    """(keys, position, item), one row per child; items sort by ``position`` within a key."""
    return children.select(*keys, _position(pos, order).alias("position"), item.alias("item"))


def nest(children: DataFrame, keys: list[str], pos: str, item: Column, name: str, order: list | None = None,
         limit: int | None = None) -> DataFrame:
    """(keys, name ARRAY), one row per key, with items sorted by ``order`` (default: position).

    With a ``limit`` the result is (keys, part, name): larger keys come as
    several rows that together, in part order, hold every child.
    """
    rows, group = (children, keys) if limit is None else (with_part(children, keys, pos, limit), [*keys, "part"])
    return (rows.groupBy(*group)
            .agg(F.array_sort(F.collect_list(F.struct(_position(pos, order).alias("k"), item.alias("v")))).alias("_items"))
            .select(*group, F.transform("_items", lambda x: x["v"]).alias(name)))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: str, how: str = "left",
                salts: int = 16, counted: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join a fact side with a side that has few rows per key, spreading hot keys.

    A key with more than ``hot_rows`` rows is handled by ``salts`` tasks: the big
    side picks one by the hash of a unique column, and the small side repeats the
    rows of such keys only.  The rows are counted in ``counted``, a table with the
    same keys that is cheaper to read than ``big``; the list of hot keys has at
    most rows / hot_rows entries.  The small side is never broadcast: its size in
    memory is not known from its files.
    """
    hot = F.broadcast((big if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                      .filter(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot")))
    spread = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.coalesce("_hot", F.lit(False)))
    left = big.join(hot, keys, "left").withColumn(
        "_salt", F.when(spread, F.pmod(F.xxhash64(salt_on), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    right = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")
