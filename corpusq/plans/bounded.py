"""Size checks for data that is to leave the distributed plan."""

from pyspark.sql import DataFrame


class TooLarge(ValueError):
    """The data exceeds the limit under which it may be held by every task."""


def small_rows(df: DataFrame, limit: int) -> list:
    """Collect a table that must have at most ``limit`` rows, else raise TooLarge.

    Never pulls more than limit + 1 rows to the driver.
    """
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} rows")
    return rows
