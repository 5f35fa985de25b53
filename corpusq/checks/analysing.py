"""Corpus statistics."""

from pyspark.sql import functions as F

from corpusq.checks.chunking import ENDS, QUALITY_SQL, STARTS, TABLE_LIKE_SQL, TOKENS, pipes
from corpusq.checks.fixtures import documents, sql_any, sql_strip, sql_text
from corpusq.checks.registry import Checks
from corpusq.functions import fixed_values as fv, quality as Q, text as T
from corpusq.operators import analytics as A
from corpusq.session import load

checks = Checks()
add = checks.add

WORDS = TOKENS.format("text")


@add("size_stats", f"""SELECT lang, count(*) AS total_chunks, min(w) AS word_min, max(w) AS word_max, round(avg(w), 6) AS word_mean, median(w)::DOUBLE AS word_median,
 round(coalesce(stddev_samp(w), 0), 6) AS word_std_dev, min(c)::INT AS char_min, max(c)::INT AS char_max, round(avg(c), 6) AS char_mean, median(c)::DOUBLE AS char_median
 FROM (SELECT lang, {WORDS} AS w, length(text) AS c FROM documents) GROUP BY 1""")
def _(spark, sf):
    stats = A.size_stats(documents(spark, sf), group=["lang"])
    return stats.withColumns({c: F.round(c, 6) for c in ("word_mean", "word_std_dev", "char_mean")})


HISTOGRAM_SQL = " UNION ALL ".join(
    f"SELECT {i} AS bin_ord, '{name}' AS bin, count(*) FILTER (w >= {low} {'' if high is None else f'AND w < {high}'}) AS n FROM w"
    for i, (name, low, high) in enumerate(fv.SIZE_BINS))


@add("size_histogram", f"WITH w AS (SELECT {WORDS} AS w FROM documents) {HISTOGRAM_SQL}")
def _(spark, sf):
    return A.size_histogram(documents(spark, sf))


@add("value_counts", """SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
 UNION ALL SELECT 'even', coalesce(CASE WHEN doc_id % 3 > 0 THEN (doc_id % 2)::VARCHAR END, 'Unknown'), count(*) FROM documents GROUP BY 2""")
def _(spark, sf):
    docs = load(spark, sf, "documents").withColumn("even", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 2))
    return A.value_counts(docs, ["lang", "source", "even"])


@add("dominance", """WITH c AS (SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 3)
 SELECT (SELECT string_agg(value || '=' || n, ',' ORDER BY n DESC, value) FROM t) AS top_values, round_even((SELECT sum(n) FROM t) / (SELECT sum(n) FROM c) * 100, 1)::DOUBLE AS top_percentage,
 (SELECT count(*) FROM c) AS unique_values, round_even((SELECT count(*) FROM c) / (SELECT sum(n) FROM c) * 100, 1)::DOUBLE AS diversity""")
def _(spark, sf):
    return A.dominance(load(spark, sf, "documents"), "lang").withColumn("top_values", F.array_join(F.transform(
        "top_values", lambda t: F.concat(t["value"], F.lit("="), t["n"].cast("string"))), ","))


# whole documents, some under a header, behind table rows or behind a phrase
PIECES_SQL = """SELECT doc_id, lang, CASE doc_id % 6 WHEN 0 THEN '# Head' || chr(10) || text WHEN 2 THEN 'x' || chr(10) || 'y' || chr(10) || 'z' || chr(10) || 'a | b | c' || chr(10) || text
 WHEN 3 THEN 'For example: ' || text WHEN 4 THEN 'Roll, see page 4 ' || text ELSE text END AS text FROM documents"""


def pieces(spark, sf):
    k, t = F.col("doc_id") % 6, F.col("text")
    text = (F.when(k == 0, F.concat(F.lit("# Head\n"), t))
            .when(k == 2, F.concat(F.lit("x\ny\nz\na | b | c\n"), t))
            .when(k == 3, F.concat(F.lit("For example: "), t))
            .when(k == 4, F.concat(F.lit("Roll, see page 4 "), t)).otherwise(t))
    return documents(spark, sf).select("doc_id", "lang", text.alias("text"))


def _lines_where(condition):
    return f"len(list_filter(string_split({sql_strip('text')}, chr(10)), lambda l: {condition}))"


S_L = sql_strip("l")
FIRST, LAST = sql_strip(f"string_split({sql_strip('text')}, chr(10))[1]"), sql_strip(f"string_split({sql_strip('text')}, chr(10))[-1]")
FLAG_SQL = {
    "empty_chunk": f"length({sql_strip('text')}) < 50",
    "header_only": f"{_lines_where(f'NOT starts_with({S_L}, {chr(39)}#{chr(39)}) AND length({S_L}) > 10')} <= 2",
    "incomplete_sentence": f"NOT regexp_matches({sql_strip('text')}, '[.!?]$')",
    "orphaned_header": f"{_lines_where(f'starts_with({S_L}, {chr(39)}#{chr(39)})')} >= 1 AND {_lines_where(f'NOT starts_with({S_L}, {chr(39)}#{chr(39)}) AND length({S_L}) > 5')} <= 1",
    "missing_context": f"length(text) <= 100 AND NOT {sql_any('lower(text)', fv.CONTEXT_WORDS)}",
    "split_mid_sentence": f"(regexp_matches({FIRST}, '^\\p{{Ll}}') AND length({FIRST}) > 10) OR (NOT regexp_matches({LAST}, '[.!?:;]$') AND length({LAST}) > 5)",
    "split_mid_table": f"{_lines_where(pipes('l') + ' > 1')} > 0 AND len(list_filter(list_slice(string_split({sql_strip('text')}, chr(10)), 1, 3), lambda l: contains(l, '---') OR ({S_L} LIKE '|%' AND {S_L} LIKE '%|'))) = 0",
}


@add("quality_flags", f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in FLAG_SQL.items())} FROM ({PIECES_SQL})")
def _(spark, sf):
    return A.quality_flags(pieces(spark, sf)).select("doc_id", *FLAG_SQL)


@add("quality_counts", f"SELECT {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in FLAG_SQL.items())} FROM ({PIECES_SQL})")
def _(spark, sf):
    return A.quality_counts(pieces(spark, sf))


EX, RU = sql_any("lower(text)", fv.ANALYSIS_EXAMPLES), sql_any("lower(text)", fv.ANALYSIS_RULES)


@add("example_vs_rule", f"""SELECT count(*) FILTER (e AND NOT r) AS examples_only, count(*) FILTER (r AND NOT e) AS rules_only, count(*) FILTER (e = r) AS unclear_or_mixed,
 round_even(count(*) FILTER (e AND NOT r) / count(*) * 100, 1)::DOUBLE AS example_percentage FROM (SELECT {EX} AS e, {RU} AS r FROM ({PIECES_SQL}))""")
def _(spark, sf):
    return A.example_vs_rule(pieces(spark, sf))


@add("cross_reference_issues", f"""SELECT count(*) AS cross_reference_issues FROM ({PIECES_SQL}) WHERE regexp_matches(lower(text), '{fv.CROSS_REFERENCE}')
 AND (contains(text, 'MISSING') OR length(text) < 200)""")
def _(spark, sf):
    return A.cross_reference_issues(pieces(spark, sf))


TOPIC = {"words": ["erad", "tionn"], "pair_words": ["ouou", "sch"], "markers": ["eaux", "der"]}
TOPIC_SQL = f"""SELECT *, contains(lower(text), 'dice pool') AND contains(lower(text), 'resist') AS rule, {sql_any('lower(text)', ['example', 'e.g.', 'for instance'])} AS example
 FROM ({PIECES_SQL}) WHERE {sql_any('lower(text)', TOPIC['words'])} OR ({sql_any('lower(text)', TOPIC['pair_words'])} AND {sql_any('lower(text)', TOPIC['markers'])})"""


@add("topic_slice", f"""WITH t AS ({TOPIC_SQL}) SELECT count(*) AS total_relevant_chunks, count(*) FILTER (rule) AS chunks_with_explicit_rules, count(*) FILTER (example AND NOT rule) AS chunks_with_examples_only,
 (SELECT string_agg(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, '#' ORDER BY doc_id) FROM (SELECT * FROM t ORDER BY doc_id LIMIT 3)) AS sample_previews FROM t""")
def _(spark, sf):
    return A.topic_slice(pieces(spark, sf), "doc_id", **TOPIC).withColumn("sample_previews", F.array_join("sample_previews", "#"))


@add("topic_classes", f"SELECT lang AS classification, count(*) AS n FROM ({TOPIC_SQL}) GROUP BY 1")
def _(spark, sf):
    return A.topic_classes(pieces(spark, sf), label="lang", **TOPIC)


REC = fv.RECOMMENDATIONS


@add("recommendations", f"""WITH s AS (SELECT lang, count(*) AS n, stddev_samp({WORDS}) AS sd, avg({WORDS}) AS m, count(*) FILTER ({EX} AND NOT {RU}) AS ex, count(*) FILTER ({RU} AND NOT {EX}) AS ru,
 count(*) FILTER ({FLAG_SQL['split_mid_sentence']}) AS mid, count(*) FILTER ({QUALITY_SQL} = 'poor') AS poor, count(*) FILTER (doc_id % 2 = 0) AS te, count(*) FILTER (doc_id % 2 = 1) AS tr FROM ({PIECES_SQL}) GROUP BY 1)
 SELECT lang, concat_ws('; ', CASE WHEN sd > m * 0.8 THEN '{REC['uneven_sizes']}' END, CASE WHEN n > 200 THEN '{REC['concentrated_classes']}' END, CASE WHEN ex > ru THEN '{REC['too_many_examples']}' END,
 CASE WHEN mid > n * 0.1 THEN '{REC['mid_sentence']}' END, CASE WHEN te > tr THEN '{REC['topic_examples']}' END,
 CASE WHEN poor / n * 100 > 20 THEN '{REC['boundary_high']}' WHEN poor / n * 100 > 10 THEN '{REC['boundary_medium']}' ELSE '{REC['boundary_good']}' END) AS recommendations FROM s""")
def _(spark, sf):
    kind = Q.example_or_rule("text")
    stats = pieces(spark, sf).groupBy("lang").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.stddev_samp(T.count_tokens("text")).alias("word_std_dev"), F.avg(T.count_tokens("text")).alias("word_mean"),
        F.count_if(kind == "examples_only").alias("examples_only"), F.count_if(kind == "rules_only").alias("rules_only"),
        F.count_if(Q.splits_mid_sentence("text")).alias("split_mid_sentence"), F.count_if(Q.boundary_quality("text") == "poor").alias("poor_boundaries"),
        F.count_if(F.col("doc_id") % 2 == 0).alias("topic_examples"), F.count_if(F.col("doc_id") % 2 == 1).alias("topic_rules"))
    stats = stats.withColumn("top_percentage", F.when(F.col("total_chunks") > 200, 90).otherwise(10))
    return A.recommendations(stats).select("lang", F.array_join("recommendations", "; ").alias("recommendations"))


@add("chunk_statistics", f"""SELECT lang, count(*) AS total_chunks, min(t) AS token_min, max(t) AS token_max, round(avg(t), 6) AS token_avg, count(*) FILTER (q = 'excellent') AS excellent,
 count(*) FILTER (q = 'good') AS good, count(*) FILTER (q = 'poor') AS poor, round((count(*) FILTER (q = 'excellent') * 3 + count(*) FILTER (q = 'good') * 2 + count(*) FILTER (q = 'poor')) / (count(*) * 3) * 100, 6) AS quality_score,
 count(*) FILTER (tab) AS table_chunks, count(*) FILTER (s OR e) AS poor_boundary_chunks FROM (SELECT lang, {WORDS} AS t, {QUALITY_SQL} AS q, {TABLE_LIKE_SQL} AS tab, {STARTS} AS s, {ENDS} AS e FROM documents) GROUP BY 1""")
def _(spark, sf):
    rows = documents(spark, sf).select("lang", T.count_tokens("text").alias("token_count"), Q.boundary_quality("text").alias("boundary_quality"), Q.is_table_content("text").alias("is_table_content"),
                                       Q.starts_mid_sentence("text").alias("starts_mid_sentence"), Q.ends_mid_sentence("text").alias("ends_mid_sentence"))
    return A.chunk_statistics(rows, ["lang"]).withColumns({c: F.round(c, 6) for c in ("token_avg", "quality_score")})


def _map_text(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def _dist(field, scope):
    return f"(SELECT string_agg({field} || '=' || n, ',' ORDER BY {field}) FROM (SELECT {field}, count(*) AS n FROM {scope} GROUP BY 1))"


def _collection(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.col("source").alias("doc_path"), F.col("lang").alias("primary_section"), (F.col("doc_id") % 3).cast("string").alias("content_type"),
                                               F.when(F.col("doc_id") % 5 == 0, "mixed").otherwise("text").alias("chunk_type"), (F.col("doc_id") % 4 == 0).alias("is_table_content"),
                                               (F.col("doc_id") % 6 == 0).alias("has_entities"), F.col("n_chars").alias("token_count"))


COLLECTION_SQL = """c AS (SELECT doc_id, source, lang, (doc_id % 3)::VARCHAR AS ct, CASE WHEN doc_id % 5 = 0 THEN 'mixed' ELSE 'text' END AS kind, doc_id % 4 = 0 AS tab, doc_id % 6 = 0 AS ent, n_chars FROM documents)"""


def _collection_sql(scope):
    return f"""WITH {COLLECTION_SQL}, s AS (SELECT * FROM c ORDER BY doc_id {scope}) SELECT (SELECT count(*) FROM c) AS total_chunks, (SELECT count(DISTINCT source) FROM c) AS indexed_files,
 {_dist('lang', 's')} AS section_distribution, {_dist('ct', 's')} AS content_type_distribution, {_dist('kind', 's')} AS chunk_type_distribution,
 (SELECT count(*) FROM s WHERE tab) AS table_chunks, (SELECT count(*) FROM s) AS sample_size"""


@add("collection_stats", _collection_sql(""))
def _(spark, sf):
    stats = A.collection_stats(_collection(spark, sf), "doc_id")
    return stats.withColumns({c: _map_text(c) for c in stats.columns if c.endswith("distribution")})


@add("collection_stats_exact", _collection_sql(""))
def _(spark, sf):
    stats = A.collection_stats(_collection(spark, sf), "doc_id", None)
    return stats.withColumns({c: _map_text(c) for c in stats.columns if c.endswith("distribution")})


@add("quality_report", f"""WITH {COLLECTION_SQL} SELECT count(*) AS sample_size, count(*) FILTER (tab) AS table_chunks, count(*) FILTER (NOT tab AND kind <> 'mixed') AS text_chunks,
 count(*) FILTER (NOT tab AND kind = 'mixed') AS mixed_chunks, count(*) FILTER (ent) AS entity_chunks, round(avg(n_chars), 6) AS average_tokens, min(n_chars) AS min_tokens, max(n_chars) AS max_tokens,
 round(count(*) FILTER (tab) / count(*) * 100, 6) AS table_preservation_score, round(count(*) FILTER (ent) / count(*) * 100, 6) AS entity_extraction_rate FROM c""")
def _(spark, sf):
    report = A.quality_report(_collection(spark, sf), "doc_id", None)
    return report.withColumns({c: F.round(c, 6) for c in ("average_tokens", "table_preservation_score", "entity_extraction_rate")})


@add("document_stats", """SELECT 'Documents' AS category, count(DISTINCT source) AS count FROM documents UNION ALL SELECT 'Text Chunks', count(*) FROM documents UNION ALL SELECT 'Active Jobs', 0
 UNION ALL SELECT 'Type: ' || CASE WHEN doc_id % 2 = 0 THEN 'rulebook' ELSE 'unknown' END, count(*) FROM documents GROUP BY 1 UNION ALL SELECT 'Edition: ' || (doc_id % 3), count(*) FROM documents GROUP BY 1
 UNION ALL SELECT 'Section: ' || lang, count(*) FROM documents GROUP BY 1""")
def _(spark, sf):
    rows = load(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 2 == 0, "rulebook").alias("document_type"), (F.col("doc_id") % 3).alias("edition"), F.col("lang").alias("primary_section"))
    return A.document_stats(rows)


KEYS = [("english", ["the ", "and", "tion", "thre", "erad", "with", "from", "that", "this", "sh ", "oul", "zzz"]), ("french", ["la ", "le ", "que", "eaux", "ouou", "ó"]), ("german", ["der", "und", "sch", "ich ", "ver"])]
KEY_SQL = " UNION ALL ".join(f"SELECT '{g}' AS group_name, '{sql_text(k)}' AS keyword, {i} AS o, count(*) FILTER (contains(lower(text), '{sql_text(k)}')) AS n FROM documents"
                             for i, (g, k) in enumerate((g, k) for g, ks in KEYS for k in ks))


@add("keyword_counts", f"""SELECT group_name, keyword, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY n DESC, o) AS rank FROM ({KEY_SQL}) WHERE n > 0) WHERE rank <= 10""")
def _(spark, sf):
    return A.keyword_counts(documents(spark, sf), KEYS)


@add("structure_counts", f"""SELECT count(*) FILTER ({pipes('text')} > 5) AS with_tables, count(*) FILTER (regexp_matches(text, '(?m)^#+')) AS with_headers,
 count(*) FILTER (contains(text, '[') AND contains(text, '](')) AS with_links, count(*) FILTER (contains(lower(text), 'of the')) AS with_phrase, count(*) FILTER (regexp_matches(lower(text), '\\bthat\\b')) AS with_word FROM documents""")
def _(spark, sf):
    return A.structure_counts(documents(spark, sf), phrase="of the", word="that")


TOPICS = {"north": ["erad", "tionn"], "south": ["sch", "der"], "east": ["eaux"], "none": ["qqqq"]}


@add("first_match_sample", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{n}' AS topic, min(doc_id) AS doc_id, left(arg_min(text, doc_id), 500) AS sample FROM documents WHERE {sql_any('lower(text)', ws)}) WHERE doc_id IS NOT NULL" for n, ws in TOPICS.items()))
def _(spark, sf):
    return A.first_match_sample(documents(spark, sf), TOPICS, "doc_id")


@add("label_diversity", """SELECT count(*) AS total, count(DISTINCT lang) AS classes, count(*) FILTER (quality = 1) AS multi_label, count(*) FILTER (contains(lower(text), 'der')) AS keyword_hits,
 round_even(count(DISTINCT lang) / count(*) * 100, 1)::DOUBLE AS diversity, count(DISTINCT lang) > 3 AS diverse, count(*) FILTER (quality = 1) > count(*) * 0.2 AS multi_labelled FROM labels JOIN documents USING (doc_id)""")
def _(spark, sf):
    rows = load(spark, sf, "labels").join(documents(spark, sf), "doc_id").select(F.col("lang").alias("primary_section"), F.when(F.col("quality") == 1, "a,b").otherwise("a").alias("sections"), F.col("text").alias("mechanical_keywords"))
    return A.label_diversity(rows, words=["der"])


@add("profile_metadata", """WITH v AS (SELECT DISTINCT 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT DISTINCT 'c_nationkey', c_nationkey::VARCHAR FROM customer
 UNION ALL SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) AS place FROM v WHERE value IS NOT NULL)
 SELECT field, string_agg(value, ',' ORDER BY value) AS examples FROM r WHERE place <= 10 GROUP BY 1""")
def _(spark, sf):
    present, _ = A.profile_metadata(load(spark, sf, "customer").drop("c_acctbal"), "c_custkey")
    return present.withColumn("examples", F.array_join("examples", ","))


@add("missing_fields", "SELECT unnest(['primary_section', 'document_type', 'edition']) AS field FROM (SELECT count(*) FROM documents)")
def _(spark, sf):
    return A.profile_metadata(load(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")[1]


@add("embedding_profile", "SELECT max(len(embedding))::INT AS embedding_dimension, count(*) AS document_count, min(vec_id) AS sample_id FROM embeddings")
def _(spark, sf):
    return A.embedding_profile(load(spark, sf, "embeddings"), key="vec_id")
