"""Pipeline operators over documents with columns of every name that they compute themselves."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusq.llm import decontam, mixing, neardup, queries, sharding

NAMES = ["size", "items", "score", "_source", "group_id", "bundle", "predicted", "held_out", "hit_spans", "n_words", "toxic_spans", "copies",
         "rate", "target", "source_size", "_copy", "own", "shard", "slot", "text_crc32", "_own_columns", "a b", "component_id", "kept", "_lost", "set_id",
         "_had_items", "_chunk", "_offset", "weight", "label"]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, an id that repeats with one text and with two, and a column of each name with its own value."""
    base = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(3, None, None, None), (None, "lonely row", "en", None), (None, None, None, None), (70, "", "en", "s"),
                                  (71, "same words", "en", "s"), (71, "same words", "en", "s"), (72, "one text", "en", "s"), (72, "another text", None, "s")],
                                 "doc_id long, text string, lang string, source string")
    named = [F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))).alias(n) for n in NAMES]
    return base.unionByName(more).select("doc_id", *named[:9], "text", "source", *named[9:], "lang").cache()


def rows(df, columns):
    return Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def stages(spark, docs):
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    return {"toxicity": queries.without_toxic(docs, labels), "near-duplicates": neardup.drop_near_duplicates(docs),
            "decontamination": decontam.drop_contaminated(docs, items), "mixing": mixing.mix(docs)}


@pytest.mark.parametrize("name", ["toxicity", "near-duplicates", "decontamination", "mixing"])
def test_own_columns_come_back_untouched(spark, docs, name):
    out = stages(spark, docs)[name]
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    had = rows(docs, docs.columns)
    got = rows(out, docs.columns)
    assert got and set(got) <= set(had)
    if name != "mixing":
        assert all(got[r] <= had[r] for r in got)
    assert stages(spark, docs.filter("false"))[name].count() == 0


def test_shards_keep_own_columns(spark, docs):
    out = sharding.shard_documents(docs)
    clash = {"size", "shard", "slot", "text_crc32"}
    assert out.columns == [f"own_{c}" if c in clash else c for c in docs.columns] + ["size", "text_crc32", "shard", "slot"]
    assert rows(out, out.columns[:-4]) == rows(docs, docs.columns)
    assert sharding.shard_documents(docs.filter("false")).count() == 0
    small = sharding.shard_documents(docs, keep=["lang"])
    assert small.columns == ["lang", "size", "text_crc32", "shard", "slot"]
