"""A batch of questions, from the request to the prompt: one operator over the store of chunks."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.operators import context as X, labelling as L, retrieval as R
from corpusq.operators.entities import COUNT_NAMES, entity_counts
from corpusq.plans.fetch import pick_rows
from corpusq.plans.scratch import keep

#: Most results a request may ask for.
MOST_RESULTS = 50
FILTERS = {"document_type": "want_document_type", "edition_key": "want_edition", "primary_section": "want_primary_section",
           "subsection": "want_subsection"}


def edition_key(edition: Column | str) -> Column:
    """Editions are written in either case; they are compared in one."""
    return F.upper(F.col(edition) if isinstance(edition, str) else edition)


def most_asked(limits: DataFrame) -> int:
    """Results that any of the requests asks for, MOST_RESULTS at most: no search ranks more."""
    return max(1, min(MOST_RESULTS, limits.agg(F.max("_n")).first()[0] or 1))


def search_requests(requests: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], categories=None, expansions=None,
                    key: str = "question_id", chunk: str = "chunk_id", search=R.knn) -> DataFrame:
    """(key, chunk, distance, rank): the n_results chunks nearest to each expanded question, under the request's own filters.

    A request's source filter is contained in the chunk's source, its other
    filters equal the chunk's values (the edition in either case).  ``search`` is ``retrieval.knn`` or a function with its parameters.
    """
    asked = L.expand_query(R.build_filter(requests), "question", categories, expansions)
    asked = asked.withColumn("query_embedding", embed(F.col("expanded"))).withColumn("want_edition", edition_key("want_edition"))
    limits = requests.select(key, F.coalesce("n_results", F.lit(5)).alias("_n"))
    found = search(asked, chunks.withColumn("edition_key", edition_key("edition")), most_asked(limits), key, chunk, per_query=FILTERS,
                   per_query_contains={"source": "want_source"})
    return found.join(limits, key).filter(F.col("rank") <= F.col("_n")).drop("_n")


def answer_questions(requests: DataFrame, chunks: DataFrame, templates: DataFrame, embed: Callable[[Column], Column], categories=None,
                     expansions=None, fetch_linked: bool = True, key: str = "question_id", chunk: str = "chunk_id", search=R.knn_stored,
                     texts: DataFrame | None = None) -> DataFrame:
    """(key, category, prompt, sources, linked_chunks, n_hits, n_chunks), one row per request.

    Category, expansion, vector, filters, search, linked chunks, merge, context,
    prompt, sources.  A request without hits keeps its row; its context says
    that nothing was found and it has no sources.  Chunk text is fetched for
    hits and their links only; it is neither searched nor sorted.

    ``texts`` (text_id, text) are the texts of the chunks, kept apart; text_id is a number of its own for
    each text.  Chunks then hold text_id and text_hash, the 16 bytes of its MD5, instead of text:
    the rows are searched, linked and merged without it, and each text that is used is fetched once.
    """
    hits = search_requests(requests, chunks, embed, categories, expansions, key, chunk, search)
    primary = R.fetch_hits(hits, chunks.drop("embedding"), chunk)
    text, digest = ("text", None) if texts is None else ("text_hash", F.lower(F.hex("text_hash")))
    if fetch_linked:
        merged = R.merge_linked(primary, R.expand_linked(primary, chunks.drop("embedding"), key, chunk), key, chunk, text, digest=digest)
    else:
        merged = primary.withColumn("is_linked", F.lit(False))
    whole = merged
    if texts is not None:
        merged = keep(merged.drop(text), "merged")
        whole = merged.join(pick_rows(merged, texts, "text_id"), "text_id")
    contexts = X.assemble_context(whole, key)
    sources = X.answer_sources(merged, key)
    counts = merged.groupBy(key).agg(F.count_if(~F.col("is_linked")).alias("n_hits"), F.count(F.lit(1)).alias("n_chunks"))
    kind = L.classify_query(requests.select(key, "question"), "question", categories).select(key, "category")
    return (X.render_prompts(requests, contexts, templates, key=key).join(kind, key).join(sources, key, "left").join(counts, key, "left")
            .withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
            .fillna(0, ["linked_chunks", "n_hits", "n_chunks"]))


def search_report(requests: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], synonyms=None, intents=None, query_types=None,
                  key: str = "question_id", chunk: str = "chunk_id", search=R.knn) -> DataFrame:
    """How a search would run, one row per request: analysis, enhanced query, records in the question, number of results.

    Columns intent, entities, query_type, confidence, enhanced_query, the
    number of records of each type that the question itself holds, results_count.
    """
    analysed = L.build_enhanced_query(L.analyze_query(requests, "question", intents=intents, query_types=query_types), synonyms=synonyms)
    asked = analysed.withColumn("query_embedding", embed(F.col("enhanced_query")))
    limits = requests.select(key, F.coalesce("n_results", F.lit(5)).alias("_n"))
    found = search(asked, chunks, most_asked(limits), key, chunk)
    counts = (found.join(limits, key).filter(F.col("rank") <= F.col("_n")).groupBy(key)
              .agg(F.count(F.lit(1)).alias("results_count")))
    names = list(COUNT_NAMES.values())
    counted = entity_counts(analysed.select(key, "question", "intent", "entities", "query_type", "confidence", "enhanced_query"), "question")
    return (counted.join(counts, key, "left").fillna(0, ["results_count"])
            .select(key, "intent", "entities", "query_type", "confidence", "enhanced_query", *names, "results_count"))
