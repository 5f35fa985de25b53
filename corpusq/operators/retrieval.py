"""Filtered nearest-neighbour retrieval, link expansion, merging and re-ranking."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.scoring import role_to_section
from corpusq.functions.text import _col, count_terms, file_name
from corpusq.operators.embedding import TfIdfModel, fit_tfidf
from corpusq.plans import vectors
from corpusq.plans.fetch import fetch_rows
from corpusq.plans.ordered import top_k

LINK_COLUMNS = ["next_chunk_global", "prev_chunk_global", "next_chunk_section", "prev_chunk_section"]


def embed_texts(texts: DataFrame, text: str = "text", dim: int = 768, out: str = "embedding",
                model: TfIdfModel | None = None) -> DataFrame:
    """Hashed TF-IDF vectors of unit length; a text without words gets the zero vector.

    Chunks and questions share weights by sharing a ``model``; without one the
    weights are fitted on these texts, which runs a job.
    """
    return (model or fit_tfidf(texts, text, dim)).transform(texts, text, out)


def build_filter(requests: DataFrame) -> DataFrame:
    """One want_* column per filter of a request; NULL means no restriction.

    A known role decides the section; otherwise the manual section does, but
    only when no role was given at all.
    """
    def given(name, *off):
        col = F.col(name)
        return F.when(F.trim(col).isin("", *off) | col.isNull(), F.lit(None).cast("string")).otherwise(col)

    role = given("character_role", "None")
    manual = F.when(role.isNull(), given("filter_section", "All"))
    return (requests
            .withColumn("want_document_type", given("filter_document_type"))
            .withColumn("want_edition", F.coalesce(
                F.when(given("filter_edition").isNotNull(), F.nullif(F.col("filter_edition"), F.lit("None")))
                .when(given("edition").isNotNull(), F.nullif(F.col("edition"), F.lit("None")))))
            .withColumn("want_source", given("filter_source"))
            .withColumn("want_primary_section", F.coalesce(F.when(role.isNotNull(), role_to_section(role)), manual))
            .withColumn("want_subsection", given("filter_subsection")))


def knn(queries: DataFrame, chunks: DataFrame, k: int = 5, key: str = "question_id", chunk: str = "chunk_id",
        query_vec: str = "query_embedding", vec: str = "embedding", where: dict | None = None,
        per_query: dict | None = None, source_contains: str | None = None, source: str = "source",
        query_limit: int = vectors.QUERY_LIMIT, per_query_contains: dict | None = None, stored: bool = False) -> DataFrame:
    """(key, chunk, distance, rank) of the k nearest chunks by cosine distance.

    ``where`` {column: value} and ``source_contains`` apply to all queries and
    are pushed to the scan; ``per_query`` {chunk column: query column} compares
    per query, and ``per_query_contains`` asks that the chunk's value contains
    the query's; NULL on the query side means any.  ``stored`` chunks are read again for each block of many queries.
    """
    conditions = [F.col(c) == v for c, v in (where or {}).items()]
    if source_contains:
        conditions.append(F.contains(source, F.lit(source_contains)))
    scope = reduce(lambda df, c: df.filter(c), conditions, chunks)
    per_query, pieces = per_query or {}, per_query_contains or {}
    q = queries.select(key, query_vec, *[F.col(qc).alias(cc) for cc, qc in {**per_query, **pieces}.items()])
    return vectors.nearest(q, scope, k, key, chunk, query_vec, vec, list(per_query), query_limit, pieces=list(pieces), stored=stored)


def knn_stored(*args, **options) -> DataFrame:
    """``knn`` over a store of chunks: however many the queries are, no vector is shuffled."""
    return knn(*args, stored=True, **options)


def unfiltered_counts(queries: DataFrame, results: DataFrame, chunks: DataFrame, k: int = 5, key: str = "question_id",
                      query_vec: str = "query_embedding", vec: str = "embedding") -> DataFrame:
    """For queries whose filtered search found nothing: how many an unfiltered search finds.

    Without a filter every chunk that has a vector is some neighbour of every query that
    has one, so the number is that of these chunks, k at most; nothing is ranked.
    """
    empty = queries.join(results.select(key).distinct(), key, "left_anti")
    usable = chunks.filter(F.size(vec) > 0).limit(k).count()
    asked = F.coalesce(F.size(query_vec) > 0, F.lit(False))
    return empty.select(key, F.when(asked, F.lit(usable)).otherwise(F.lit(0)).cast("bigint").alias("fallback_count"))


def overfetch(queries: DataFrame, chunks: DataFrame, k: int, rerank, **options) -> DataFrame:
    """Search 2k, re-rank, keep k.  ``rerank`` maps results to results with a rank column."""
    return rerank(knn(queries, chunks, 2 * k, **options)).filter(F.col("rank") <= k)


# ---- links -----------------------------------------------------------------------------
def expand_linked(results: DataFrame, chunks: DataFrame, key: str = "question_id", chunk: str = "chunk_id") -> DataFrame:
    """Chunks linked from the primary hits, with distance 0.0.

    ``results`` already carries the link columns of its chunks; the rows of
    ``chunks`` are fetched by id and not sorted.
    """
    ids = results.select(key, F.explode(F.array(*LINK_COLUMNS)).alias(chunk)).filter(F.col(chunk).isNotNull()).distinct()
    return fetch_rows(ids, chunks, chunk).withColumn("distance", F.lit(0.0)).withColumn("is_linked", F.lit(True))


def fetch_hits(hits: DataFrame, chunks: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Hits with the columns of their chunks."""
    return fetch_rows(hits, chunks, chunk)


def merge_linked(primary: DataFrame, linked: DataFrame, key: str = "question_id", chunk: str = "chunk_id",
                 text: str = "text", sentinel: bool = False, digest: Column | None = None) -> DataFrame:
    """Primary hits by distance, then linked ones by section and position, texts not repeated.

    With ``sentinel`` any row with distance exactly 0.0 is sorted as linked.  ``digest`` is
    the MD5 of the text, if the rows have another column in its place.
    """
    digest = F.md5(text) if digest is None else digest
    columns = [key, chunk, text, "distance", "is_linked", "section_id", "chunk_index"]
    first = primary.withColumn("is_linked", F.lit(False))
    extra = [c for c in first.columns if c in linked.columns and c not in columns]
    seen = first.select(key, digest.alias("_t")).distinct()
    fresh = (linked.withColumn("_t", digest).join(seen, [key, "_t"], "left_anti"))
    fresh = top_k(fresh, [key, "_t"], [F.col(chunk)], 1, "_n").drop("_t", "_n")
    rows = first.select(*columns, *extra).unionByName(fresh.select(*columns, *extra))
    late = (F.col("distance") == 0.0) if sentinel else F.col("is_linked")
    order = Window.partitionBy(key).orderBy(
        late.asc(), F.when(~late, F.col("distance")).asc_nulls_last(),
        F.coalesce(F.when(late, F.coalesce("section_id", F.lit("zzz"))), F.lit("")),
        F.coalesce(F.when(late, F.coalesce("chunk_index", F.lit(999))), F.lit(0)), F.col(chunk))
    return rows.withColumn("rank", F.row_number().over(order))


# ---- re-ranking --------------------------------------------------------------------------
def boost(results: DataFrame, boosts: dict | None = None, category: str = "category", text: str = "text",
          key: str = "question_id", chunk: str = "chunk_id") -> DataFrame:
    """distance x (1 - 0.1 x contained boost terms of the query's category), re-ranked."""
    low = F.lower(_col(text))
    hits = F
    for name, terms in (fv.CATEGORY_BOOSTS if boosts is None else boosts).items():
        hits = hits.when(F.col(category) == name, count_terms(low, [t.lower() for t in terms]))
    boosted = results.withColumn("distance", F.col("distance") * (1 - hits.otherwise(F.lit(0)) * F.lit(0.1)))
    order = Window.partitionBy(key).orderBy(F.col("distance").asc_nulls_last(), F.col(chunk))
    return boosted.withColumn("rank", F.row_number().over(order))


def entity_rerank(base: DataFrame, related: DataFrame, chunks: DataFrame, limit: int = 10, key: str = "question_id",
                  chunk: str = "chunk_id") -> DataFrame:
    """Score x 1.5 when the chunk belongs to an entity of the question; missing related chunks join with 0.7.

    ``base(key, chunk, score, rank)``, ``related(key, chunk, entity_ord)``.
    """
    once = top_k(base, [key, chunk], [F.col("rank")], 1, "_n").drop("_n")
    marks = related.groupBy(key, chunk).agg(F.min("entity_ord").alias("entity_ord"))
    both = once.join(marks, [key, chunk], "full_outer")
    known = F.col("rank").isNotNull()
    scored = (both.withColumn("score", F.when(~known, F.lit(0.7)).otherwise(
        F.coalesce("score", F.lit(0.5)) * F.when(F.col("entity_ord").isNotNull(), 1.5).otherwise(1.0)))
        .withColumn("entity_related", F.col("entity_ord").isNotNull())
        .withColumn("_late", ~known))
    ranked = top_k(scored.withColumnRenamed("rank", "_base"), [key],
                   [F.col("score").desc(), F.col("_late"), F.coalesce("_base", "entity_ord"), F.col(chunk)], limit)
    texts = fetch_rows(ranked.select(chunk).distinct(), chunks.select(chunk, "text"), chunk)
    return ranked.join(texts, chunk, "left").select(key, chunk, "score", "rank", "entity_related", "text")


# ---- document search -----------------------------------------------------------------------
def search_documents(docs: DataFrame, query: str = "", group: str | None = None, document_type: str | None = None,
                     edition: str | None = None, page: int = 1, page_size: int = 20, path: str = "doc_path",
                     text: str = "text") -> DataFrame:
    """One page of documents whose file name, else content, contains the query, with totals.

    Paging takes the first page x size rows by path; the total is one counting pass.
    """
    wanted = query.lower()
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    scope = docs.withColumn("filename", file_name(path)).withColumn("group_name", folder)
    if group:
        scope = scope.filter(F.col("group_name") == group)
    if document_type or edition:
        block = F.regexp_extract(text, r"(?s)^---(.*?)---", 1)
        has = F.rlike(text, F.lit(r"(?s)^---.*?---"))
        for name, value in (("document_type", document_type), ("edition", edition)):
            if value:
                scope = scope.filter(~has | F.contains(block, F.lit(f'{name}: "{value}"')))
    by_name = F.contains(F.lower("filename"), F.lit(wanted))
    in_text = F.contains(F.lower(text), F.lit(wanted))
    kind = F.lit("filename") if not wanted else F.when(by_name, "filename").when(in_text, "content")
    hits = scope.withColumn("match_type", kind).filter(F.col("match_type").isNotNull())
    total = hits.agg(F.count(F.lit(1))).scalar()
    return (hits.select(path, "filename", "group_name", "match_type").orderBy(path)
            .offset((page - 1) * page_size).limit(page_size)
            .withColumn("total", total)
            .withColumn("total_pages", F.ceil(F.col("total") / F.lit(page_size))))


def group_documents(paths: DataFrame, path: str = "doc_path", root: str | None = None) -> DataFrame:
    """(group_name, filename, relative_path); "other" outside the root.  Long form: a folder may be of any size."""
    col = F.col(path)
    parts = F.split(col, "/")
    inside = F.startswith(col, F.lit(root + "/")) if root else F.lit(True)
    relative = F.substr(col, F.lit(len(root) + 2)) if root else col
    return paths.select(
        F.when(inside & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise("other").alias("group_name"),
        F.when(inside, file_name(path)).otherwise(col).alias("filename"),
        F.when(inside, relative).otherwise(col).alias("relative_path"))
