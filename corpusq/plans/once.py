"""Evaluate a costly expression once."""

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Like withColumn, but the optimizer cannot copy ``value`` into later filters and projections.

    A filter on an ordinary computed column is pushed below it together with a
    copy of the expression, so a long text chain would run twice or more.  The
    output of a generator is never inlined; the stage stays narrow.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name)).select(*[c for c in df.columns if c != name], name)
