"""Incremental index maintenance: fingerprints, manifest, replacement of chunks, run summaries."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.text import any_term
from corpusq.plans.fetch import without_rows

NEW, CHANGED, UNCHANGED, ORPHAN = "new", "changed", "unchanged", "orphan"


def filter_rulebook_docs(docs: DataFrame, text: str = "text", indicators=None,
                         min_len: int = fv.RULEBOOK_MIN_CHARS) -> DataFrame:
    return docs.filter((F.length(text) >= min_len) & any_term(F.lower(text), indicators or fv.RULEBOOK_INDICATORS))


def fingerprint(docs: DataFrame, path: str = "doc_path", text: str = "text") -> DataFrame:
    """The listing to compare with the manifest: path, MD5 of the bytes, size."""
    return docs.select(F.col(path), F.md5(text).alias("hash"), F.octet_length(text).alias("file_size"))


def diff_manifest(listing: DataFrame, manifest: DataFrame, path: str = "doc_path", force: bool = False) -> DataFrame:
    """Status of every path of either side.  Only path and hash travel, never text."""
    now = listing.select(path, F.col("hash").alias("new_hash"))
    was = manifest.select(path, F.col("hash").alias("old_hash"))
    status = (F.when(F.col("new_hash").isNull(), ORPHAN)
              .when(F.col("old_hash").isNull(), NEW)
              .when(F.lit(force) | (F.col("new_hash") != F.col("old_hash")), CHANGED)
              .otherwise(UNCHANGED))
    return now.join(was, path, "full_outer").select(path, "new_hash", "old_hash", status.alias("status"))


def upsert_chunks(store: DataFrame, new_chunks: DataFrame, removed: DataFrame, path: str = "doc_path") -> DataFrame:
    """Replace every chunk of the paths in new_chunks, drop those of the removed paths.

    The store's rows stay where they are.  ``streaming/store.py`` keeps a store
    on disk in which only the buckets of these paths are rewritten.
    """
    gone = new_chunks.select(path).unionByName(removed.select(path))
    return without_rows(store, gone, path).unionByName(new_chunks, allowMissingColumns=True)


def update_manifest(chunks: DataFrame, listing: DataFrame, indexed_at: Column | None = None,
                    path: str = "doc_path") -> DataFrame:
    """One row per indexed path.  Counts are combined before the shuffle, so a hot path is cheap."""
    counts = chunks.groupBy(path).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if("is_table_content").alias("table_chunks"),
        F.count_if(~F.col("is_table_content")).alias("text_chunks"))
    stamp = F.current_timestamp() if indexed_at is None else indexed_at
    return listing.join(counts, path).withColumn("indexed_at", stamp)


def index_run_summary(statuses: DataFrame) -> DataFrame:
    """Totals of a run over (doc_path, status, error, entities); the first three errors by path."""
    first_errors = statuses.filter(F.col("status") == "failed").orderBy("doc_path").limit(3)
    errors = first_errors.agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_path", "error"))),
                                          lambda e: e["error"]).alias("e"))
    totals = statuses.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "indexed").alias("indexed_files"),
        F.count_if(F.col("status") == "skipped").alias("skipped_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
        F.coalesce(F.sum("entities"), F.lit(0)).alias("entities_extracted"),
        F.count_if(F.col("entities") > 0).alias("files_with_entities"))
    return totals.withColumn("errors", errors.scalar())


def normalise_metadata(chunks: DataFrame, arrays: list[str] = (), maps: list[str] = (),
                       scalars: list[str] = ()) -> DataFrame:
    """Flatten metadata to strings: lists joined by ", ", maps as JSON, empties and NULLs absent."""
    keep = [c for c in chunks.columns if c not in {*arrays, *maps, *scalars}]
    flat = ([F.struct(F.lit(c).alias("k"), F.when(F.size(c) > 0, F.array_join(c, ", ")).alias("v")) for c in arrays]
            + [F.struct(F.lit(c).alias("k"), F.when(F.size(c) > 0, F.to_json(c)).alias("v")) for c in maps]
            + [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in scalars])
    present = F.filter(F.array(*flat), lambda e: e["v"].isNotNull())
    return chunks.select(*keep, F.map_from_entries(present).alias("metadata"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values (document list, available sections, gear categories)."""
    return df.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


def get_document(docs: DataFrame, path, key: str = "doc_path") -> DataFrame:
    """Point lookup; the equality reaches the scan."""
    return docs.filter(F.col(key) == path)
