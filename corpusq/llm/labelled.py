"""Bounded samples of labelled rows for fitting the classifiers."""

from pyspark.sql import Column, DataFrame, functions as F


def crc_mod(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def clean_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label): one row per id; ids without a label, or with two different ones, are left out."""
    return (labels.select("doc_id", F.col(name).cast("int").alias("label")).filter("doc_id is not null and label is not null")
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
            .filter("label = _other").drop("_other"))


def thin(rows: DataFrame, share: float, seed: str) -> DataFrame:
    """A share of the rows in expectation, however small, chosen by the 63 low bits of the hash of the id."""
    if share >= 1:
        return rows
    place = F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit(2 ** 63 - 1))
    return rows.filter(place < F.lit(int(share * 2 ** 63)))
