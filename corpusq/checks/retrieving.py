"""Nearest neighbours, links, re-ranking and context assembly.

Every embedding is a query and a chunk; labels stand for sections.
"""

from pyspark.sql import functions as F

from corpusq.checks.chunking import LINKS_SQL, PACK_SQL, TOKENS, packed_documents
from corpusq.checks.fixtures import CHUNKS_SQL, conversation_chunks, documents, sql_count
from corpusq.checks.labelling import (ANALYSIS_SQL, CATEGORY_SQL, CATS, EXPANSIONS, INTENTS, QUESTIONS_SQL, SYN, TYPES, analysed,
                                      analysis_sql, argmax_sql, questions)
from corpusq.checks.registry import Checks
from corpusq.functions.text import count_tokens
from corpusq.functions import extensions as U
from corpusq.operators import answering as A, chunks as C, context as X, embedding as EM, labelling as L, retrieval as R, search_store as SS, vector_index as VI
from corpusq.plans.scratch import keep, shared_folder
from corpusq.session import load, load_spread

checks = Checks()
add = checks.add


def _vectors(spark, sf):
    return load_spread(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("section"))


def _queries(spark, sf):
    return load_spread(spark, sf, "embeddings", "vec_id").select(
        F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_embedding"), F.col("label").alias("want"))


def knn_sql(k, extra="", on="true"):
    return f"""SELECT question_id, chunk_id, round(distance, 6) AS distance, rank::INT AS rank {extra} FROM (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id,
 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance, c.label AS section, row_number() OVER (PARTITION BY q.vec_id
 ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12), c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON {on}) WHERE rank <= {k}"""


def _rounded(df):
    # adding zero turns a rounded -0.0 into 0.0
    return df.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@add("knn", knn_sql(5))
def _(spark, sf):
    return _rounded(R.knn(_queries(spark, sf), _vectors(spark, sf), 5))


@add("knn_where", knn_sql(5, on="c.label = 3"))
def _(spark, sf):
    return _rounded(R.knn(_queries(spark, sf), _vectors(spark, sf), 5, where={"section": 3}))


@add("knn_per_query_filter", knn_sql(3, on="(q.label % 3 = 0 OR c.label = q.label)"))
def _(spark, sf):
    queries = _queries(spark, sf).withColumn("want", F.when(F.col("want") % 3 != 0, F.col("want")))
    return _rounded(R.knn(queries, _vectors(spark, sf), 3, per_query={"section": "want"}))


@add("knn_blocked", knn_sql(4))
def _(spark, sf):
    return _rounded(R.knn(_queries(spark, sf), _vectors(spark, sf), 4, query_limit=200))


# labels stand for books; a third of the queries names a piece of a book's path
@add("knn_source_contains", knn_sql(4, on="(q.vec_id % 3 <> 0 OR contains('lib/book-' || c.label || '/x.md', 'k-' || (q.vec_id % 4)))"))
def _(spark, sf):
    books = _vectors(spark, sf).withColumn("source", F.concat(F.lit("lib/book-"), F.col("section").cast("string"), F.lit("/x.md")))
    queries = _queries(spark, sf).withColumn("want", F.when(F.col("question_id") % 3 == 0, F.concat(
        F.lit("k-"), (F.col("question_id") % 4).cast("string"))))
    return _rounded(R.knn(queries, books, 4, per_query_contains={"source": "want"}))


def _index(spark, sf):
    store = shared_folder(spark, "vector-index")
    VI.build_index(_vectors(spark, sf), store, columns=("section",), cells=24, chunk_rows=60)
    return store


# the audit asks every query here, so that the probes are widened until the result is the exact one
@add("knn_index", knn_sql(5))
def _(spark, sf):
    return _rounded(VI.search_index(_queries(spark, sf), _index(spark, sf), 5, recall=1.0, audit=1 << 20))


@add("knn_index_filtered", knn_sql(3, on="c.label % 2 = 1 AND (q.label % 3 = 0 OR c.label = q.label)"))
def _(spark, sf):
    queries = _queries(spark, sf).withColumn("want", F.when(F.col("want") % 3 != 0, F.col("want")))
    store = shared_folder(spark, "vector-index")
    VI.build_index(_vectors(spark, sf).withColumn("odd", F.col("section") % 2), store, columns=("odd", "section"), cells=10)
    return _rounded(VI.search_index(queries, store, 3, recall=1.0, audit=1 << 20, where={"odd": 1}, per_query={"section": "want"}))


@add("unfiltered_counts", "SELECT vec_id AS question_id, 5::BIGINT AS fallback_count FROM embeddings WHERE label % 2 = 0")
def _(spark, sf):
    queries = _queries(spark, sf).withColumn("want", F.when(F.col("want") % 2 == 0, 99).otherwise(F.col("want")))
    found = R.knn(queries, _vectors(spark, sf), 5, per_query={"section": "want"})
    return R.unfiltered_counts(queries.drop("want"), found, _vectors(spark, sf), 5)


REQUESTS_SQL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rulebook' WHEN 1 THEN '  ' END AS filter_document_type,
 CASE event_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'SR4' WHEN 2 THEN '' END AS filter_edition, CASE WHEN event_id % 2 = 0 THEN 'SR5' END AS edition,
 CASE WHEN event_id % 3 = 0 THEN event_type END AS filter_source, CASE event_id % 6 WHEN 0 THEN 'Decker' WHEN 1 THEN 'None' WHEN 2 THEN 'baker' END AS character_role,
 CASE event_id % 7 WHEN 0 THEN 'All' WHEN 1 THEN '' ELSE 'Gear' END AS filter_section, CASE WHEN event_id % 2 = 1 THEN 'sub' END AS filter_subsection FROM events"""


@add("build_filter", f"""SELECT event_id, nullif(trim(filter_document_type), '') AS want_document_type,
 nullif(coalesce(nullif(filter_edition, ''), edition), 'None') AS want_edition, filter_source AS want_source,
 CASE WHEN nullif(character_role, 'None') IS NOT NULL THEN CASE lower(character_role) WHEN 'decker' THEN 'Matrix' END
 ELSE nullif(nullif(filter_section, 'All'), '') END AS want_primary_section, filter_subsection AS want_subsection FROM ({REQUESTS_SQL})""")
def _(spark, sf):
    e = F.col("event_id")
    none = F.lit(None).cast("string")
    requests = load(spark, sf, "events").select(
        "event_id", F.when(e % 4 == 0, "rulebook").when(e % 4 == 1, "  ").otherwise(none).alias("filter_document_type"),
        F.when(e % 5 == 0, "None").when(e % 5 == 1, "SR4").when(e % 5 == 2, "").otherwise(none).alias("filter_edition"),
        F.when(e % 2 == 0, "SR5").otherwise(none).alias("edition"), F.when(e % 3 == 0, F.col("event_type")).alias("filter_source"),
        F.when(e % 6 == 0, "Decker").when(e % 6 == 1, "None").when(e % 6 == 2, "baker").otherwise(none).alias("character_role"),
        F.when(e % 7 == 0, "All").when(e % 7 == 1, "").otherwise("Gear").alias("filter_section"),
        F.when(e % 2 == 1, "sub").otherwise(none).alias("filter_subsection"))
    wants = [c for c in R.build_filter(requests).columns if c.startswith("want_")]
    return R.build_filter(requests).select("event_id", *wants)


# ---- results over conversation chunks ----------------------------------------------------
# a system or even turn is a hit of its conversation; distance falls with the length of the text
CHUNK_ROWS_SQL = f"""SELECT c.*, l.* EXCLUDE (chunk_id), turn::INT AS chunk_index FROM ({CHUNKS_SQL}) c JOIN ({LINKS_SQL}) l USING (chunk_id)"""
HITS_SQL = """SELECT *, conv_id AS question_id, CASE WHEN turn = 0 THEN 0.0 ELSE 1.0 / (1 + length(text)) END AS distance,
 row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = 0 THEN 0.0 ELSE 1.0 / (1 + length(text)) END, chunk_id) AS rank
 FROM rows WHERE turn % 3 = 0"""


def _chunk_rows(spark, sf):
    return C.link_sequential(conversation_chunks(spark, sf)).withColumn("chunk_index", F.col("turn").cast("int"))


def _hits(spark, sf):
    from pyspark.sql import Window
    distance = F.when(F.col("turn") == 0, 0.0).otherwise(F.lit(1.0) / (1 + F.length("text")))
    rows = (_chunk_rows(spark, sf).filter("turn % 3 = 0").withColumn("question_id", F.col("conv_id"))
            .withColumn("distance", distance))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("distance", "chunk_id")))


LINKED_SQL = """SELECT DISTINCT question_id, id AS chunk_id FROM (SELECT question_id, unnest([next_chunk_global, prev_chunk_global,
 next_chunk_section, prev_chunk_section]) AS id FROM hits) WHERE id IS NOT NULL"""
WITH_HITS = f"WITH rows AS ({CHUNK_ROWS_SQL}), hits AS ({HITS_SQL}), linked AS ({LINKED_SQL})"


@add("expand_linked", f"{WITH_HITS} SELECT question_id, chunk_id, text, 0.0::DOUBLE AS distance, true AS is_linked FROM linked JOIN rows USING (chunk_id)")
def _(spark, sf):
    return R.expand_linked(_hits(spark, sf), _chunk_rows(spark, sf)).select("question_id", "chunk_id", "text", "distance", "is_linked")


def _merged_sql(late):
    return f"""{WITH_HITS}, fresh AS (SELECT question_id, min(chunk_id) AS chunk_id FROM linked JOIN rows USING (chunk_id)
 WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.question_id = linked.question_id AND h.text = rows.text) GROUP BY question_id, text),
 both_ AS (SELECT question_id, chunk_id, text, distance::DOUBLE AS distance, false AS is_linked, section_id, chunk_index FROM hits UNION ALL
 SELECT question_id, chunk_id, text, 0.0, true, section_id, chunk_index FROM fresh JOIN rows USING (chunk_id))
 SELECT question_id, chunk_id, text, distance, is_linked, (row_number() OVER (PARTITION BY question_id ORDER BY {late}, CASE WHEN NOT {late} THEN distance END,
 CASE WHEN {late} THEN section_id ELSE '' END, CASE WHEN {late} THEN chunk_index ELSE 0 END, chunk_id))::INT AS rank FROM both_"""


def _merged(spark, sf, sentinel=False):
    hits = _hits(spark, sf)
    return R.merge_linked(hits, R.expand_linked(hits, _chunk_rows(spark, sf)), sentinel=sentinel)


MERGED = ["question_id", "chunk_id", "text", "distance", "is_linked", "rank"]


@add("merge_linked", _merged_sql("is_linked"))
def _(spark, sf):
    return _merged(spark, sf).select(*MERGED)


@add("merge_linked_sentinel", _merged_sql("(distance = 0.0)"))
def _(spark, sf):
    return _merged(spark, sf, True).select(*MERGED)


BOOSTS = {"north": ["The ", "tion", "and"], "south": ["der", "und"], "east": ["la ", "le ", "que", "les"]}
ROLE_CATEGORY = {"user": "north", "assistant": "south", "system": "east"}
BOOST_CASE = "CASE role " + " ".join(f"WHEN '{r}' THEN {sql_count('lower(text)', [t.lower() for t in BOOSTS[c]])}" for r, c in ROLE_CATEGORY.items()) + " ELSE 0 END"


@add("boost", f"""{WITH_HITS} SELECT question_id, chunk_id, round(d, 9) AS distance, (row_number() OVER (PARTITION BY question_id ORDER BY round(d, 12), chunk_id))::INT AS rank
 FROM (SELECT *, distance * (1 - {BOOST_CASE} * 0.1::DOUBLE) AS d FROM hits)""")
def _(spark, sf):
    category = F.col("role")
    for role, name in ROLE_CATEGORY.items():
        category = F.when(F.col("role") == role, name).otherwise(category)
    hits = _hits(spark, sf).withColumn("category", category)
    return R.boost(hits, BOOSTS).select("question_id", "chunk_id", F.round("distance", 9).alias("distance"), "rank")


RELATED_SQL = "SELECT conv_id AS question_id, chunk_id, turn AS entity_ord FROM rows WHERE turn % 2 = 0"


@add("entity_rerank", f"""{WITH_HITS}, related AS ({RELATED_SQL}), s AS (SELECT coalesce(h.question_id, r.question_id) AS question_id, coalesce(h.chunk_id, r.chunk_id) AS chunk_id,
 CASE WHEN h.chunk_id IS NULL THEN 0.7 ELSE (1.0 / h.rank) * CASE WHEN r.chunk_id IS NULL THEN 1.0 ELSE 1.5 END END::DOUBLE AS score, h.chunk_id IS NULL AS late,
 coalesce(h.rank, r.entity_ord) AS o, r.chunk_id IS NOT NULL AS entity_related FROM hits h FULL OUTER JOIN related r ON h.question_id = r.question_id AND h.chunk_id = r.chunk_id)
 SELECT question_id, chunk_id, round(score, 9) AS score, rank::INT AS rank, entity_related, text FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, late, o, chunk_id) AS rank FROM s)
 JOIN (SELECT chunk_id, text FROM rows) USING (chunk_id) WHERE rank <= 3""")
def _(spark, sf):
    rows = _chunk_rows(spark, sf)
    base = _hits(spark, sf).select("question_id", "chunk_id", (F.lit(1.0) / F.col("rank")).alias("score"), "rank")
    related = rows.filter("turn % 2 = 0").select(F.col("conv_id").alias("question_id"), "chunk_id", F.col("turn").alias("entity_ord"))
    return R.entity_rerank(base, related, rows, 3).withColumn("score", F.round("score", 9))


@add("overfetch", f"""SELECT question_id, chunk_id, round(d, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 12), chunk_id) AS rank
 FROM (SELECT question_id, chunk_id, distance * CASE WHEN section % 2 = 0 THEN 0.5 ELSE 1 END AS d FROM (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, c.label AS section,
 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY q.vec_id
 ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12), c.vec_id) AS r FROM embeddings q JOIN embeddings c ON true) WHERE r <= 6)) WHERE rank <= 3""")
def _(spark, sf):
    from pyspark.sql import Window
    vectors = _vectors(spark, sf)

    def rerank(found):
        halved = found.join(vectors.select("chunk_id", "section"), "chunk_id").withColumn(
            "distance", F.col("distance") * F.when(F.col("section") % 2 == 0, 0.5).otherwise(1.0))
        order = Window.partitionBy("question_id").orderBy(F.round("distance", 12), "chunk_id")
        return halved.withColumn("rank", F.row_number().over(order))
    return _rounded(R.overfetch(_queries(spark, sf), vectors, 3, rerank)).select("question_id", "chunk_id", "distance", "rank")


# ---- context -------------------------------------------------------------------------------
RESULTS_SQL = """SELECT *, CASE WHEN turn % 2 = 0 THEN 'rule book' END AS document_type, 'SR5' AS edition, CASE WHEN role = 'user' THEN 'Gear' END AS primary_section,
 CASE WHEN turn = 0 THEN 'Intro' END AS subsection, CASE WHEN turn % 5 <> 4 THEN doc_path END AS source, 'Part ' || role AS section_title, turn <> 3 AS has_metadata FROM hits"""


def _results(spark, sf):
    t = F.col("turn")
    return (_hits(spark, sf).withColumn("document_type", F.when(t % 2 == 0, "rule book")).withColumn("edition", F.lit("SR5"))
            .withColumn("primary_section", F.when(F.col("role") == "user", "Gear")).withColumn("subsection", F.when(t == 0, "Intro"))
            .withColumn("source", F.when(t % 5 != 4, F.col("doc_path"))).withColumn("section_title", F.concat(F.lit("Part "), "role"))
            .withColumn("has_metadata", t != 3))


SRC = "coalesce(regexp_extract(source, '([^/]*)$', 1), 'Unknown')"
TITLE = "CASE WHEN document_type IS NULL THEN 'Unknown' ELSE 'Rule Book' END"
NL2 = "chr(10) || chr(10)"


@add("assemble_context", f"""{WITH_HITS}, res AS ({RESULTS_SQL}) SELECT question_id, string_agg(CASE WHEN has_metadata THEN '[' || {TITLE} || ' | ' || edition || ' | ' || coalesce(primary_section, 'General')
 || ' → ' || coalesce(subsection, 'General') || ' | Source: ' || {SRC} || ']' ELSE '[Source: Unknown]' END || chr(10) || text, {NL2} || '---' || {NL2} ORDER BY rank) AS context FROM res GROUP BY 1""")
def _(spark, sf):
    return X.assemble_context(_results(spark, sf))


@add("assemble_simple_context", f"{WITH_HITS}, res AS ({RESULTS_SQL}) SELECT question_id, string_agg(coalesce('[' || primary_section || '] ', '') || text, {NL2} ORDER BY rank) AS context FROM res GROUP BY 1")
def _(spark, sf):
    return X.assemble_simple_context(_results(spark, sf))


@add("assemble_context_by_section", f"""{WITH_HITS}, res AS ({RESULTS_SQL}), p AS (SELECT *, CASE WHEN has_metadata THEN '[' || {TITLE} || ' | ' || edition || ' | ' || section_title ||
 CASE WHEN total_chunks_in_section > 1 THEN ' | Part ' || (chunk_index + 1) || '/' || total_chunks_in_section || CASE WHEN NOT section_complete THEN ' (continued)' ELSE '' END ELSE '' END
 || ' | Source: ' || {SRC} || ']' ELSE '[Source: Unknown]' END || chr(10) || text AS part FROM res),
 b AS (SELECT question_id, 0 AS g, min(rank) AS o, '## Section: ' || arg_min(section_title, (chunk_index, rank)) || {NL2} || string_agg(part, {NL2} ORDER BY chunk_index, rank) || {NL2} || '---' AS t
 FROM p WHERE has_metadata GROUP BY question_id, section_id UNION ALL SELECT question_id, 1, rank, part FROM p WHERE NOT has_metadata)
 SELECT question_id, string_agg(t, {NL2} ORDER BY g, o) AS context FROM b GROUP BY 1""")
def _(spark, sf):
    return X.assemble_context_by_section(_results(spark, sf))


@add("answer_sources", f"""{WITH_HITS}, res AS (SELECT * REPLACE (doc_path || '#' || role AS source) FROM ({RESULTS_SQL})) SELECT question_id, string_agg(source, ',' ORDER BY o) AS sources, sum(n)::BIGINT AS linked_chunks
 FROM (SELECT question_id, source, min(rank) AS o, count(next_chunk_global) AS n FROM res GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    rows = _results(spark, sf).withColumn("source", F.concat_ws("#", "doc_path", "role"))
    return X.answer_sources(rows).withColumn("sources", F.array_join("sources", ","))


TEMPLATES = [("general", "G {character_context}|{edition_context}|{context}|{question}"), ("rules", "Rules: {context}\nQ: {question} {edition_context}")]


@add("render_prompts", """SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'Rules: ' || full_ || chr(10) || 'Q: ' || question || ' ' || ed
 ELSE 'G ' || CASE question_id % 2 WHEN 0 THEN '**Character Context:** Current character role: Decker; Character stats: Logic 5' ELSE '' END || '|' || ed || '|' || full_ || '|' || question END AS prompt
 FROM (SELECT item_id AS question_id, text AS question, CASE WHEN item_id % 5 = 0 THEN 'CONVERSATION HISTORY:' || chr(10) || 'earlier' || chr(10) || chr(10) || 'CURRENT CONTEXT:' || chr(10) ELSE '' END || CASE WHEN item_id % 7 = 3 THEN 'No relevant information found in the indexed documents. Try adjusting your filters or search terms.' ELSE lower(text) END AS full_,
 CASE WHEN item_id % 4 <> 1 THEN '**Preferred Edition:** SR5. Default to this unless context suggests otherwise.' ELSE '' END AS ed FROM benchmark)""")
def _(spark, sf):
    q = F.col("question_id")
    asked = load(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")).select(
        "*", F.when(q % 3 == 0, "rules").otherwise("nothing known").alias("query_type"),
        F.when(q % 2 == 0, "decker").alias("character_role"), F.when(q % 2 == 0, "Logic 5").alias("character_stats"),
        F.when(q % 4 != 1, "SR5").alias("edition"), F.when(q % 5 == 0, "earlier").alias("conversation_context"))
    # a seventh of the questions found nothing
    contexts = asked.filter(q % 7 != 3).select("question_id", F.lower("question").alias("context"))
    templates = spark.createDataFrame(TEMPLATES, "query_type string, template string")
    return X.render_prompts(asked, contexts, templates)


# ---- the whole path: benchmark items and user turns ask the chunks of all documents --------------------------------
LETTERS = "aeioldnrstu"
STORE_SQL = f"""SELECT p.*, 'doc-' || doc_id || '_section_0_chunk_' || chunk_index AS chunk_id, 'doc-' || doc_id || '_section_0' AS section_id,
 'lib/' || source || '/doc-' || doc_id || '.md' AS source, CASE lang WHEN 'en' THEN 'rulebook' WHEN 'fr' THEN 'big adventure' END AS document_type,
 CASE WHEN doc_id % 2 = 0 THEN 'sr4' ELSE 'SR5' END AS edition, CASE doc_id % 5 WHEN 0 THEN 'Matrix' WHEN 1 THEN 'Gear' WHEN 2 THEN 'Magic' END AS primary_section, lang AS subsection,
 CASE WHEN chunk_index > 0 THEN 'doc-' || doc_id || '_section_0_chunk_' || (chunk_index - 1) END AS prev_id,
 CASE WHEN chunk_index < max(chunk_index) OVER (PARTITION BY doc_id) THEN 'doc-' || doc_id || '_section_0_chunk_' || (chunk_index + 1) END AS next_id
 FROM ({PACK_SQL}) p JOIN documents USING (doc_id)"""
REQUESTS_OF_ALL_SQL = """SELECT *, length(question) AS h FROM (SELECT 'item-' || item_id AS question_id, text AS question FROM benchmark UNION ALL
 SELECT 'conv-' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user')"""


def _letters_sql(text):
    return "[1.0::DOUBLE, " + ", ".join(f"(length({text}) - length(replace({text}, '{x}', '')))::DOUBLE" for x in LETTERS) + "]"


def _letter_counts():
    return lambda texts: [[1.0, *[float(t.count(x)) for x in LETTERS]] for t in texts]


ANSWER_SQL = f"""WITH store AS MATERIALIZED (SELECT *, {_letters_sql('text')} AS v FROM ({STORE_SQL})),
 r AS MATERIALIZED (SELECT *, 1 + h % 6 AS n, CASE WHEN h % 4 = 0 THEN 'rulebook' END AS w_type,
 CASE WHEN h % 5 = 0 THEN NULL WHEN h % 5 = 1 THEN 'SR4' WHEN h % 2 = 0 THEN 'SR5' END AS w_edition, CASE h % 7 WHEN 0 THEN 'src1' WHEN 1 THEN 'no such source' END AS w_source,
 CASE WHEN h % 6 = 0 THEN 'Matrix' WHEN h % 6 = 2 THEN NULL WHEN h % 5 = 1 THEN 'Gear' END AS w_section, CASE WHEN h % 9 = 0 THEN 'en' END AS w_sub,
 CASE category WHEN 'north' THEN question || ' compass up' WHEN 'east' THEN question || ' sunrise side' ELSE question END AS expanded
 FROM (SELECT *, {argmax_sql('lower(question)', CATS)} AS category FROM ({REQUESTS_OF_ALL_SQL}))),
 asked AS (SELECT *, {_letters_sql('expanded')} AS qv FROM r),
 hits AS MATERIALIZED (SELECT * FROM (SELECT question_id, n, s.*, round(1 - list_cosine_similarity(qv, v), 12) AS distance,
 row_number() OVER (PARTITION BY question_id ORDER BY round(1 - list_cosine_similarity(qv, v), 12), chunk_id) AS place FROM asked a JOIN store s ON
 (w_type IS NULL OR w_type = s.document_type) AND (w_edition IS NULL OR w_edition = upper(s.edition)) AND (w_source IS NULL OR contains(s.source, w_source))
 AND (w_section IS NULL OR w_section = s.primary_section) AND (w_sub IS NULL OR w_sub = s.subsection)) WHERE place <= n),
 linked AS (SELECT DISTINCT question_id, id FROM (SELECT question_id, unnest([prev_id, next_id]) AS id FROM hits) WHERE id IS NOT NULL),
 fresh AS (SELECT question_id, min(chunk_id) AS chunk_id FROM linked l JOIN store s ON l.id = s.chunk_id
 WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.question_id = l.question_id AND h.text = s.text) GROUP BY question_id, text),
 both_ AS (SELECT question_id, chunk_id, text, distance, false AS late, source, document_type, edition, primary_section, subsection, section_id, chunk_index, next_id FROM hits
 UNION ALL SELECT question_id, chunk_id, text, 0.0, true, source, document_type, edition, primary_section, subsection, section_id, chunk_index, next_id FROM fresh JOIN store USING (chunk_id)),
 ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY late, CASE WHEN NOT late THEN distance END, CASE WHEN late THEN section_id ELSE '' END,
 CASE WHEN late THEN chunk_index ELSE 0 END, chunk_id) AS rank FROM both_),
 ctx AS (SELECT question_id, string_agg('[' || CASE document_type WHEN 'rulebook' THEN 'Rulebook' WHEN 'big adventure' THEN 'Big Adventure' ELSE 'Unknown' END || ' | ' || edition || ' | '
 || coalesce(primary_section, 'General') || ' → ' || subsection || ' | Source: ' || regexp_extract(source, '([^/]*)$', 1) || ']' || chr(10) || text, {NL2} || '---' || {NL2} ORDER BY rank) AS context,
 count(*) FILTER (NOT late) AS n_hits, count(*) AS n_chunks, count(next_id) AS linked_chunks FROM ranked GROUP BY 1),
 src AS (SELECT question_id, string_agg(source, ',' ORDER BY o) AS sources FROM (SELECT question_id, source, min(rank) AS o FROM ranked GROUP BY 1, 2) GROUP BY 1),
 said AS (SELECT r.*, coalesce(n_hits, 0) AS n_hits, coalesce(n_chunks, 0) AS n_chunks, coalesce(linked_chunks, 0) AS linked_chunks, coalesce(sources, '') AS sources,
 CASE WHEN h % 8 = 0 THEN 'CONVERSATION HISTORY:' || chr(10) || 'earlier' || {NL2} || 'CURRENT CONTEXT:' || chr(10) ELSE '' END
 || coalesce(context, 'No relevant information found in the indexed documents. Try adjusting your filters or search terms.') AS full_,
 CASE WHEN h % 2 = 0 THEN '**Preferred Edition:** SR5. Default to this unless context suggests otherwise.' ELSE '' END AS ed,
 CASE h % 6 WHEN 0 THEN '**Character Context:** Current character role: Decker; Character stats: Logic 5' WHEN 1 THEN '**Character Context:** Current character role: None'
 WHEN 2 THEN '**Character Context:** Current character role: Baker' ELSE '' END AS who FROM r LEFT JOIN ctx USING (question_id) LEFT JOIN src USING (question_id))
 SELECT question_id, category, sha256(CASE WHEN h % 3 = 0 THEN 'Rules: ' || full_ || chr(10) || 'Q: ' || question || ' ' || ed ELSE 'G ' || who || '|' || ed || '|' || full_ || '|' || question END) AS prompt,
 sources, linked_chunks::BIGINT AS linked_chunks, n_hits::BIGINT AS n_hits, n_chunks::BIGINT AS n_chunks FROM said"""


def chunk_store(spark, sf):
    """(chunks of all documents with links, metadata and vectors; their texts by text_id).

    Texts are packed and embedded where they lie and stored once; only the narrow rows are joined.
    """
    from corpusq.plans.once import compute_once
    doc = F.col("doc_id")
    meta = load(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("lib/"), "source", F.lit("/doc-"), doc.cast("string"), F.lit(".md")).alias("source"),
        F.when(F.col("lang") == "en", "rulebook").when(F.col("lang") == "fr", "big adventure").alias("document_type"),
        F.when(doc % 2 == 0, "sr4").otherwise("SR5").alias("edition"),
        F.when(doc % 5 == 0, "Matrix").when(doc % 5 == 1, "Gear").when(doc % 5 == 2, "Magic").alias("primary_section"), F.col("lang").alias("subsection"))
    numbered = packed_documents(spark, sf).select("*", F.monotonically_increasing_id().alias("text_id"), F.unhex(F.md5("text")).alias("text_hash"))
    packed = keep(compute_once(numbered, "embedding", U.register_embedder(_letter_counts, 1 + len(LETTERS))("text")), "packed")
    rows = packed.drop("text").join(meta, "doc_id").withColumn("section_index", F.lit(0)).withColumn(
        "chunk_id", C.chunk_id(F.col("source"), F.col("section_index"), F.col("chunk_index"))).withColumn("chunk_pos", F.col("chunk_index"))
    linked = C.link_sequential(rows, "source").drop("doc_id", "section_index", "chunk_pos", "total_chunks_in_section", "section_complete")
    return keep(linked, "chunk-store"), packed.select("text_id", "text")


def requests(spark, sf):
    items = load(spark, sf, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("question_id"), F.col("text").alias("question"))
    turns = load(spark, sf, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question"))
    h, none = F.length("question"), F.lit(None).cast("string")
    return items.unionByName(turns).select(
        "*", (1 + h % 6).alias("n_results"), F.when(h % 3 == 0, "rules").otherwise("nothing known").alias("query_type"),
        F.when(h % 4 == 0, "rulebook").when(h % 4 == 1, " ").otherwise(none).alias("filter_document_type"),
        F.when(h % 5 == 0, "None").when(h % 5 == 1, "SR4").otherwise(none).alias("filter_edition"), F.when(h % 2 == 0, "SR5").otherwise(none).alias("edition"),
        F.when(h % 7 == 0, "src1").when(h % 7 == 1, "no such source").otherwise(none).alias("filter_source"),
        F.when(h % 6 == 0, "Decker").when(h % 6 == 1, "None").when(h % 6 == 2, "baker").otherwise(none).alias("character_role"),
        F.when(h % 5 == 0, "All").when(h % 5 == 1, "Gear").when(h % 5 == 2, "").otherwise(none).alias("filter_section"),
        F.when(h % 9 == 0, "en").otherwise(none).alias("filter_subsection"), F.when(h % 6 == 0, "Logic 5").otherwise(none).alias("character_stats"),
        F.when(h % 8 == 0, "earlier").otherwise(none).alias("conversation_context"))


@add("answer_questions", ANSWER_SQL)
def _(spark, sf):
    templates = spark.createDataFrame(TEMPLATES, "query_type string, template string")
    embed = U.register_embedder(_letter_counts, 1 + len(LETTERS))
    chunks, texts = chunk_store(spark, sf)
    answers = A.answer_questions(requests(spark, sf), chunks, templates, embed, CATS, EXPANSIONS, texts=texts)
    return answers.withColumn("prompt", F.sha2("prompt", 256)).withColumn("sources", F.array_join("sources", ","))


# a quarter of the questions quotes a program's attack line
QUOTED_SQL = f"""SELECT question_id, h, question || CASE WHEN h % 4 = 0 THEN chr(10) || 'PATROL **Attack:** Host Rating x 2 v. Logic + 3' || {NL2} || 'It finds you.' ELSE '' END AS question
 FROM ({REQUESTS_OF_ALL_SQL})"""


@add("search_report", f"""SELECT question_id, intent, array_to_string(entities, ',') AS entities, query_type, confidence,
 array_to_string(list_concat([question], list_filter(boosts, lambda t: NOT contains(lower(question), t)),
 list_filter(list_transform(entities, lambda e: CASE e WHEN 'erad' THEN 'radial' WHEN 'ouou' THEN 'owl' WHEN 'der' THEN 'of it' END), lambda s: s IS NOT NULL)), ' ') AS enhanced_query,
 0::BIGINT AS weapons, 0::BIGINT AS spells, (CASE WHEN h % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS ic_programs, least(1 + h % 6, (SELECT count(*) FROM documents))::BIGINT AS results_count
 FROM ({analysis_sql(QUOTED_SQL)}) JOIN (SELECT question_id, h FROM ({REQUESTS_OF_ALL_SQL})) USING (question_id)""")
def _(spark, sf):
    embed = U.register_embedder(_letter_counts, 1 + len(LETTERS))
    quoted = F.when(F.length("question") % 4 == 0, F.concat("question", F.lit(
        "\nPATROL **Attack:** Host Rating x 2 v. Logic + 3\n\nIt finds you."))).otherwise(F.col("question"))
    chunks = load_spread(spark, sf, "documents", "doc_id").select(F.col("doc_id").alias("chunk_id"), embed("text").alias("embedding"))
    report = A.search_report(requests(spark, sf).withColumn("question", quoted), chunks, embed, SYN, INTENTS, TYPES)
    return report.withColumn("entities", F.array_join("entities", ","))


@add("conversation_context", """SELECT conv_id, CASE WHEN length(c) > 400 THEN array_to_string(list_slice(string_split(c, chr(10)), greatest(len(string_split(c, chr(10))) - 5, 1), len(string_split(c, chr(10)))), chr(10)) ELSE c END AS context
 FROM (SELECT conv_id, string_agg('Previous Q' || i || ': ' || text || chr(10) || 'Previous A' || i || ': ' || answer, chr(10) ORDER BY i) AS c
 FROM (SELECT conv_id, text, answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
 FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant') WHERE r <= 3) GROUP BY 1)""")
def _(spark, sf):
    return X.conversation_context(load(spark, sf, "conversations"), 3, 100, 6)


SEARCH_SQL = """SELECT 'lib/' || source || '/doc-' || doc_id || '.md' AS doc_path, 'doc-' || doc_id || '.md' AS filename, source AS group_name,
 '---' || chr(10) || 'edition: "' || lang || '"' || chr(10) || '---' || chr(10) || text AS text, doc_id % 4 AS fm, text AS plain FROM documents"""


@add("search_documents", f"""WITH d AS (SELECT doc_path, filename, group_name, CASE WHEN fm > 0 THEN text ELSE plain END AS text, fm, lang FROM ({SEARCH_SQL}) JOIN (SELECT 'doc-' || doc_id || '.md' AS filename, lang FROM documents) USING (filename)),
 h AS (SELECT *, CASE WHEN contains(lower(filename), '7') THEN 'filename' WHEN contains(lower(text), '7') THEN 'content' END AS match_type FROM d WHERE fm = 0 OR lang = 'en')
 SELECT doc_path, filename, group_name, match_type, (SELECT count(*) FROM h WHERE match_type IS NOT NULL) AS total,
 ceil((SELECT count(*) FROM h WHERE match_type IS NOT NULL) / 15.0)::BIGINT AS total_pages FROM h WHERE match_type IS NOT NULL ORDER BY doc_path LIMIT 15 OFFSET 30""")
def _(spark, sf):
    doc = F.col("doc_id").cast("string")
    docs = documents(spark, sf).select(
        F.concat(F.lit("lib/"), "source", F.lit("/doc-"), doc, F.lit(".md")).alias("doc_path"),
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit('---\nedition: "'), "lang", F.lit('"\n---\n'), "text")).otherwise(F.col("text")).alias("text"))
    return R.search_documents(docs, "7", edition="en", page=3, page_size=15)


def _stored_pages(term, after):
    return f"""(SELECT '{term}' AS term, doc_path, filename, CASE WHEN contains(lower(filename), '{term}') THEN 'filename' ELSE 'content' END AS match_type FROM ({SEARCH_SQL})
 WHERE (contains(lower(filename), '{term}') OR contains(lower(plain), '{term}')) AND doc_path > '{after}' ORDER BY doc_path LIMIT 12)"""


# second pages: a rare term, one of many documents, one that is shorter than a signature's groups
PAGES_ASKED = [("oc-77", "lib/src1"), ("ouou", "lib/src2/doc-5"), ("9", "lib/src4/doc-7.md"), ("no such words", "")]


@add("search_store", " UNION ALL ".join(f"SELECT * FROM {_stored_pages(*p)}" for p in PAGES_ASKED))
def _(spark, sf):
    docs = documents(spark, sf).select(F.concat(F.lit("lib/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"), "text")
    path, found = shared_folder(spark, "search"), None
    SS.write_search_store(docs, path, block_rows=25)
    for term, after in PAGES_ASKED:
        page = SS.search_store(spark, path, term, after, 12).withColumn("term", F.lit(term))
        found = page if found is None else found.unionByName(page)
    return found


@add("group_documents", """SELECT page_id, CASE WHEN url LIKE 'https://%' AND len(string_split(url, '/')) > 1 THEN string_split(url, '/')[-2] ELSE 'other' END AS group_name,
 CASE WHEN url LIKE 'https://%' THEN string_split(url, '/')[-1] ELSE url END AS filename, CASE WHEN url LIKE 'https://%' THEN substr(url, 9) ELSE url END AS relative_path FROM pages""")
def _(spark, sf):
    pages = load(spark, sf, "pages")
    grouped = R.group_documents(pages, "url", root="https:/")
    return pages.select("page_id", "url").join(grouped.withColumn("url", F.when(F.col("group_name") == "other", F.col("filename")).otherwise(
        F.concat(F.lit("https://"), "relative_path"))).distinct(), "url").drop("url")


@add("debug_retrieval", f"""{WITH_HITS}, res AS ({RESULTS_SQL}) SELECT question_id, (rank - 1)::INT AS chunk_index_in_results, coalesce(primary_section, 'Unknown') AS classification, role AS content_type,
 role = 'user' AS contains_rules, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))::INT AS word_count, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview,
 count(*) OVER (PARTITION BY question_id) AS chunks_count FROM res""")
def _(spark, sf):
    rows = _results(spark, sf).withColumn("content_type", F.col("role")).withColumn("contains_rules", F.col("role") == "user")
    return X.debug_retrieval(rows)


@add("search_debug", f"""SELECT question_id, intent, query_type, confidence, c.category, len(entities)::INT AS n_entities,
 array_to_string(list_concat([question], list_filter(boosts, lambda t: NOT contains(lower(question), t)),
 list_filter(list_transform(entities, lambda e: CASE e WHEN 'erad' THEN 'radial' WHEN 'ouou' THEN 'owl' WHEN 'der' THEN 'of it' END), lambda s: s IS NOT NULL)), ' ') AS enhanced_query
 FROM ({ANALYSIS_SQL}) a JOIN (SELECT question_id, category FROM ({CATEGORY_SQL})) c USING (question_id)""")
def _(spark, sf):
    looked = L.build_enhanced_query(analysed(spark, sf), synonyms=SYN)
    sorted_out = L.classify_query(looked, categories=CATS)
    return sorted_out.select("question_id", "intent", "query_type", "confidence", "category", F.size("entities").alias("n_entities"), "enhanced_query")


# every turn: some text, thinking, some text; nested tags in odd turns
TAGGED_SQL = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN left(text, 20) || '<think>' || lower(left(text, 30)) || '</think>' || text
 ELSE '<think>a<think>' || left(text, 9) || '</think>b</think>' || text END AS text FROM conversations"""


def tagged(spark, sf):
    t = F.col("text")
    even = F.concat(F.left(t, F.lit(20)), F.lit("<think>"), F.lower(F.left(t, F.lit(30))), F.lit("</think>"), t)
    odd = F.concat(F.lit("<think>a<think>"), F.left(t, F.lit(9)), F.lit("</think>b</think>"), t)
    return load(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, even).otherwise(odd).alias("text"))


SPLIT_SQL = """SELECT conv_id, 0::BIGINT AS part, string_agg(CASE WHEN turn % 2 = 0 THEN lower(left(text, 30)) ELSE 'a' || left(text, 9) || 'b' END, '' ORDER BY turn) AS thinking,
 string_agg(CASE WHEN turn % 2 = 0 THEN left(text, 20) || text ELSE text END, '' ORDER BY turn) AS answer FROM conversations GROUP BY 1"""


def tag_stream(spark, sf):
    return X.tag_tokens(tagged(spark, sf), ["conv_id", "turn"]).select(
        "conv_id", (F.col("turn") * 100 + F.col("seq")).alias("seq"), "token")


@add("split_reasoning", SPLIT_SQL)
def _(spark, sf):
    return X.split_reasoning(tag_stream(spark, sf))


# closing tags without an opening one, nested and unclosed tags; an unclosed one runs into the next turn
STRAY = {0: ["</think>", ("left", 9), "<think>", ("left", 30), "</think></think>", ("all",)],
         1: [("left", 12), "<think>", ("left", 7), "<think>", ("left", 8), "</think>", ("all",)],
         2: ["</think></think>", ("left", 5), "<think>", ("all",), "</think>", ("left", 6), "</think>", ("left", 3)]}


def _stray_sql():
    part = {"left": lambda n: f"left(text, {n})", "all": lambda: "text"}
    texts = {k: " || ".join(f"'{p}'" if isinstance(p, str) else part[p[0]](*p[1:]) for p in parts) for k, parts in STRAY.items()}
    return f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {texts[0]} WHEN 1 THEN {texts[1]} ELSE {texts[2]} END AS text FROM conversations"


def stray(spark, sf):
    part = {"left": lambda n: F.left("text", F.lit(n)), "all": lambda: F.col("text")}
    texts = {k: F.concat(*[F.lit(p) if isinstance(p, str) else part[p[0]](*p[1:]) for p in parts]) for k, parts in STRAY.items()}
    kind = F.col("turn") % 3
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).otherwise(texts[2]).alias("text"))


# the rule, one token after the other: an opening tag goes one deeper, a closing tag one up, but only from inside
STRAY_SQL = f"""WITH RECURSIVE tokens AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n, token FROM (
 SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT conv_id, turn,
 list_filter(string_split(replace(replace(text, '<think>', chr(1) || '<think>' || chr(1)), '</think>', chr(1) || '</think>' || chr(1)), chr(1)),
 lambda p: p <> '') AS t FROM ({_stray_sql()})))),
 walk AS (SELECT conv_id, 0::BIGINT AS n, ''::VARCHAR AS token, 0 AS depth FROM (SELECT DISTINCT conv_id FROM tokens) UNION ALL
 SELECT t.conv_id, t.n, t.token, CASE WHEN t.token = '<think>' THEN depth + 1 WHEN t.token = '</think>' AND depth > 0 THEN depth - 1 ELSE depth END
 FROM walk w JOIN tokens t ON t.conv_id = w.conv_id AND t.n = w.n + 1)
 SELECT conv_id, coalesce(string_agg(token, '' ORDER BY n) FILTER (depth > 0), '') AS thinking,
 coalesce(string_agg(token, '' ORDER BY n) FILTER (depth = 0), '') AS answer FROM walk WHERE token NOT IN ('<think>', '</think>') GROUP BY 1"""


@add("split_reasoning_stray", STRAY_SQL)
def _(spark, sf):
    # a turn has its own range of positions, so turns of any length stay apart
    tokens = X.tag_tokens(stray(spark, sf), ["conv_id", "turn"]).select(
        "conv_id", (F.shiftleft("turn", 32) + F.col("seq")).alias("seq"), "token")
    return X.split_reasoning(tokens).drop("part")


# one model, fitted on the documents and stored, gives the vectors of documents and questions; values that are not zero
_WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda w: w <> '')"
_PLACES_SQL = f"list_transform({_WORDS_SQL}, lambda w: ('0x' || md5(w)[1:8])::BIGINT % 32)"
EMBEDDED_SQL = f"""WITH t AS (SELECT 'doc-' || doc_id AS id, text FROM documents UNION ALL SELECT 'item-' || item_id, text FROM benchmark),
 p AS (SELECT id, unnest({_PLACES_SQL}) AS place FROM t), idf AS (SELECT place, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(DISTINCT id))) AS w
 FROM p WHERE starts_with(id, 'doc-') GROUP BY 1), v AS (SELECT id, p.place, count(*) * coalesce(any_value(w), ln((1 + (SELECT count(*) FROM documents))::DOUBLE)) AS x
 FROM p LEFT JOIN idf ON p.place = idf.place GROUP BY ALL)
 SELECT id, place::INT AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS value FROM v"""


@add("embed_texts_values", f"SELECT * FROM ({EMBEDDED_SQL}) WHERE value <> 0")
def _(spark, sf):
    docs = documents(spark, sf).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "text")
    items = load(spark, sf, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"), "text")
    path = shared_folder(spark, "tfidf")
    EM.fit_tfidf(docs, dim=32).save(spark, path)
    model = EM.TfIdfModel.load(spark, path)
    vectors = docs.unionByName(items).select("id", F.posexplode(model.vector("text")).alias("place", "value"))
    return vectors.withColumn("value", F.round("value", 6)).filter("value <> 0")


@add("embed_texts", f"""SELECT doc_id, 64 AS dim, CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squared_length, {TOKENS.format("text")} AS words FROM documents""")
def _(spark, sf):
    vec = R.embed_texts(documents(spark, sf).select("doc_id", "text"), dim=64)
    return vec.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("squared_length"),
        count_tokens("text").alias("words"))
