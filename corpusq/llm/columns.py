"""Documents' own columns kept apart while an operator computes columns of any name."""

from pyspark.sql import DataFrame, functions as F

OWN = "_own_columns"


def hold(docs: DataFrame, need: list[str]) -> DataFrame:
    """The needed columns and one struct of all others, so that no computed name can meet a document's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in need]
    return docs.select(*need, (F.struct(*others) if others else F.lit(None).cast("struct<none: int>")).alias(OWN))


def release(held: DataFrame, columns: list[str], need: list[str], added: list[str] = ()) -> DataFrame:
    """The documents' columns as they came, then ``added``; an own column named like an added one comes as own_<name>."""
    taken = {c.lower() for c in added}

    def own(c):
        column = F.col(c) if c in need else F.col(OWN).getField(c)
        return column.alias(f"own_{c}" if c.lower() in taken else c)
    return held.select(*[own(c) for c in columns], *added)
