"""Hashed TF-IDF vectors: weights are fitted once, stored, and shared by chunks and questions.

A word's place is a hash of its letters, so no vocabulary travels.  ``fit`` is
one aggregate over (place, documents); the model is one number per place.
Applying a model is a narrow stage and runs no job.
"""

from dataclasses import dataclass
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DIM = 768


def words(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(column), r"(?U)\W+"), lambda w: w != "")


def places(text: Column | str, dim: int) -> Column:
    """ARRAY<INT>: the place of every word, in order."""
    return F.transform(words(text), lambda w: F.pmod(F.conv(F.left(F.md5(w.cast("binary")), F.lit(8)), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


@dataclass(frozen=True)
class TfIdfModel:
    """Weights per place; a vector is counts x weights, scaled to length 1 (a text without words gets zeros)."""

    weights: tuple[float, ...]

    def vector(self, text: Column | str) -> Column:
        """ARRAY<DOUBLE>"""
        weights = np.array(self.weights)

        def weigh(found: pa.Array) -> pa.Array:
            row = np.repeat(np.arange(len(found)), np.asarray(found.value_lengths().fill_null(0)))
            out = np.bincount(row * len(weights) + np.asarray(found.flatten()), minlength=len(found) * len(weights))
            out = out.reshape(len(found), -1) * weights
            length = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out /= np.where(length > 0, length, 1.0)
            ends = np.arange(len(found) + 1, dtype=np.int32) * len(weights)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
        return F.arrow_udf(weigh, "array<double>")(places(text, len(weights)))

    def transform(self, texts: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        return texts.withColumn(out, self.vector(text).cast("array<float>"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(list(enumerate(self.weights)), "place int, weight double").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TfIdfModel":
        rows = spark.read.parquet(path).orderBy("place").collect()  # one row per place
        return TfIdfModel(tuple(r["weight"] for r in rows))


def fit_tfidf(texts: DataFrame, text: str = "text", dim: int = DIM) -> TfIdfModel:
    """Weight of a place: ln((1 + texts) / (1 + texts that hold it)); at most ``dim`` + 1 rows leave the plan."""
    held = texts.select(F.explode(F.concat(F.array(F.lit(-1)), F.coalesce(F.array_distinct(places(text, dim)), F.array()))).alias("place"))
    counts = {r["place"]: r["count"] for r in held.groupBy("place").count().collect()}
    total = counts.get(-1, 0)
    return TfIdfModel(tuple(math.log((1 + total) / (1 + counts.get(i, 0))) for i in range(dim)))
