"""The index path as one operator: from documents to labelled chunks, records, edges, vectors and the manifest."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.operators import entities as E, maintenance as M
from corpusq.operators.chunks import annotate_quality, chunk_documents, clean_documents
from corpusq.operators.labelling import classify_by_patterns
from corpusq.plans.scratch import shared_folder

#: Columns that ``enrich_chunks`` adds for a store of chunks, without the vector.
ENRICHED = "primary_section string, content_type string, weapons bigint, spells bigint, ic_programs bigint, has_entities boolean, embedding array<float>"


def enrich_chunks(chunks: DataFrame, embed: Callable[[Column], Column] | None = None, lexicon=None, patterns=None) -> DataFrame:
    """Chunks with section and content labels, record counts and a vector; row by row, nothing is shuffled."""
    labelled = classify_by_patterns(chunks, lexicon=lexicon, patterns=patterns)
    counted = E.entity_counts(labelled)
    vector = embed(F.col("text")) if embed else F.lit(None)
    return counted.withColumn("embedding", vector.cast("array<float>"))


def index_documents(docs: DataFrame, embed: Callable[[Column], Column] | None = None, lexicon=None, patterns=None, source: str = "source",
                    indexed_at: Column | None = None, **chunking) -> dict[str, DataFrame]:
    """{chunks, weapon, spell, ic, edges, manifest, summary} of (doc_path, source, text).

    The chunks are made once and stored; records, edges and manifest are read
    from the store.  A document that is blank after cleaning has no chunks and counts as skipped.
    A chunk for which the embedder fails ends the run with its error.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "index")
    cleaned = clean_documents(docs).drop("chars_removed")
    enriched = enrich_chunks(annotate_quality(chunk_documents(cleaned, **chunking)), embed, lexicon, patterns)
    enriched.write.parquet(path)
    chunks = spark.read.parquet(path)
    records = E.extract_entities(chunks.filter("has_entities"), source=source)
    listing = M.fingerprint(docs)
    per_path = chunks.groupBy("doc_path").agg(F.sum(F.col("weapons") + F.col("spells") + F.col("ic_programs")).alias("entities"))
    manifest = M.update_manifest(chunks, listing, indexed_at).join(per_path, "doc_path")
    statuses = listing.select("doc_path").join(per_path, "doc_path", "left").select(
        "doc_path", F.when(F.col("entities").isNull(), "skipped").otherwise("indexed").alias("status"), F.lit(None).cast("string").alias("error"),
        F.coalesce("entities", F.lit(0)).alias("entities"))
    return {"chunks": chunks, **records, "edges": E.entity_chunk_edges(records), "manifest": manifest,
            "summary": M.index_run_summary(statuses)}
