"""Sections, tables, packing, chunk flags and links."""

from pyspark.sql import functions as F

from corpusq.checks.fixtures import (CHUNKS_SQL, MD_SQL, OUTLINE_SQL, TABLE_SQL, conversation_chunks, documents,
                                     md_docs, outline_docs, sql_any, sql_count, sql_strip, table_docs)
from corpusq.checks.registry import Checks
from corpusq.functions import fixed_values as fv, quality as Q, text as T
from corpusq.operators import chunks as C, packing as P, sections as S
from corpusq.session import load

checks = Checks()
add = checks.add

SENTENCES = r"string_split(regexp_replace({0}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))"
TOKENS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda t: t <> ''))::INT"


def line_rows(sql, cols):
    return (f"SELECT {cols}, unnest(string_split(text, chr(10))) AS line, "
            f"generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ({sql})")


def headers_sql(source):
    return f"""WITH l AS (SELECT *, {sql_strip('line')} AS s FROM ({line_rows(source, 'doc_id')})),
 h AS (SELECT *, regexp_matches(s, '^#{{1,3}}\\s+\\S') AS head FROM l),
 g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM h),
 sec AS (SELECT doc_id, grp, coalesce(max(CASE WHEN head THEN {sql_strip("regexp_replace(s, '^#+', '')")} END), '') AS section_title,
 coalesce(max(CASE WHEN head THEN length(regexp_extract(s, '^(#+)', 1)) END), 1)::INT AS section_level,
 coalesce(string_agg(CASE WHEN NOT head THEN line || chr(10) END, '' ORDER BY n), '') AS content FROM g GROUP BY 1, 2)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INT AS section_index, section_title, section_level, content
 FROM sec WHERE {sql_strip('content')} <> '' UNION ALL SELECT doc_id, 0, 'Content', 1, text FROM ({source}) WHERE doc_id NOT IN
 (SELECT doc_id FROM sec WHERE {sql_strip('content')} <> '') AND {sql_strip('text')} <> ''"""


@add("split_by_headers", headers_sql(MD_SQL))
def _(spark, sf):
    return S.split_by_headers(md_docs(spark, sf).select("doc_id", "text"))


BOUNDARY = "^(?:" + "|".join(f"(?:{p})" for p in fv.SEMANTIC_BOUNDARIES) + ")$"


def _level(expr):
    words = sql_any(f"upper({expr})", fv.TABLE_SECTION_WORDS)
    return (f"CASE WHEN {expr} LIKE '#%' THEN length(regexp_extract({expr}, '^(#+)', 1)) WHEN contains({expr}, '|') AND {words} THEN 2 "
            f"WHEN length({expr}) > 10 AND {expr} = upper({expr}) AND {expr} <> lower({expr}) THEN 1 "
            f"WHEN regexp_matches({expr}, '^\\d+\\.') THEN 2 ELSE 3 END")


def _semantic_sql(source):
    return f"""WITH l AS (SELECT *, {sql_strip('line')} AS s FROM ({line_rows(source, 'doc_id')})),
 h AS (SELECT *, n > 1 AND regexp_matches(s, '{BOUNDARY}') AS head,
 sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 2 AS before FROM l),
 g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM h),
 sec AS (SELECT doc_id, grp, arg_min(s, n) AS first, {sql_strip("string_agg(line, chr(10) ORDER BY n)")} AS content,
 arg_min(before, n) AS before, min(n) - 1 AS a, max(n) - 1 AS b FROM g GROUP BY 1, 2)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INT AS section_index,
 CASE WHEN grp = 0 THEN 'Content' ELSE first END AS section_title, (CASE WHEN grp = 0 THEN 1 ELSE {_level('first')} END)::INT AS section_level,
 content, (CASE WHEN grp = 0 THEN 0 ELSE before END)::INT AS start_pos, a::INT AS line_start, b::INT AS line_end
 FROM sec WHERE content <> ''"""


@add("split_semantic", _semantic_sql(OUTLINE_SQL))
def _(spark, sf):
    return S.split_semantic(outline_docs(spark, sf))


@add("header_level", f"SELECT doc_id, n::INT AS n, ({_level('line')})::INT AS level FROM ({line_rows(OUTLINE_SQL, 'doc_id')})")
def _(spark, sf):
    lines = outline_docs(spark, sf).select("doc_id", F.posexplode(T.lines("text")).alias("n", "line"))
    return lines.select("doc_id", (F.col("n") + 1).alias("n"), Q.header_level("line").alias("level"))


# state machine over the lines of all documents at once, one line number per step
def tables_sql(source):
    return f"""WITH RECURSIVE raw AS (SELECT *, {sql_strip('line')} AS s FROM ({line_rows(source, 'doc_id')})),
 l AS (SELECT doc_id, n, s, length(s) - length(replace(s, '|', '')) >= 2 AS two, contains(s, '|') AS piped,
 coalesce(regexp_matches(lead(s) OVER (PARTITION BY doc_id ORDER BY n), '^[\\s|:\\-]+$'), false) AS ruled,
 {sql_any('lower(s)', fv.DETECT_STAT_WORDS)} AS stat,
 s = '' OR NOT (s LIKE '#%' OR {TOKENS.format('s')} > 20 OR NOT regexp_matches(s, '[\\d\\-]')) AS stat_row FROM raw),
 st AS (SELECT doc_id, 0::BIGINT AS n, 0 AS mode, 0::BIGINT AS start, false AS ended, 0 AS was, 0::BIGINT AS was_start FROM (SELECT DISTINCT doc_id FROM l)
 UNION ALL SELECT * FROM (SELECT l.doc_id, l.n, CASE WHEN goes THEN mode WHEN two AND ruled THEN 1 WHEN NOT two AND stat THEN 2 ELSE 0 END AS mode,
 CASE WHEN goes THEN start ELSE l.n END AS start, NOT goes AND mode > 0 AS ended, mode AS was, start AS was_start FROM
 (SELECT l.*, st.mode, st.start, (st.mode = 1 AND (l.n = st.start + 1 OR piped)) OR (st.mode = 2 AND stat_row) AS goes
 FROM st JOIN l ON l.doc_id = st.doc_id AND l.n = st.n + 1) l)),
 e AS (SELECT doc_id, was AS mode, was_start AS start, n - 1 AS stop FROM st WHERE ended
 UNION ALL SELECT st.doc_id, st.mode, st.start, st.n FROM st JOIN (SELECT doc_id, max(n) AS n FROM l GROUP BY 1) m ON st.doc_id = m.doc_id AND st.n = m.n WHERE st.mode > 0)
 SELECT doc_id, (start - 1)::INT AS start_line, (stop - 1)::INT AS end_line, CASE mode WHEN 1 THEN 'markdown_table' ELSE 'weapon_stats' END AS table_type
 FROM e WHERE mode = 1 OR stop > start"""


TABLES_SQL = tables_sql(TABLE_SQL)


@add("detect_tables", TABLES_SQL)
def _(spark, sf):
    return S.detect_tables(table_docs(spark, sf).select("doc_id", "text"))


BLOCKS_SQL = f"""WITH RECURSIVE found AS (SELECT doc_id, arg_min(table_type, start_line) AS first_type FROM ({TABLES_SQL}) GROUP BY 1),
 l AS (SELECT r.doc_id, n, line, length(line) - length(replace(line, '|', '')) >= 2 OR {sql_any('lower(line)', fv.BLOCK_STAT_WORDS)} AS opens,
 contains(line, '|') OR {sql_strip('line')} = '' OR (first_type = 'weapon_stats' AND regexp_matches(line, '[\\d\\-]')) AS goes
 FROM ({line_rows(TABLE_SQL, 'doc_id')}) r JOIN found USING (doc_id)),
 st AS (SELECT doc_id, 0::BIGINT AS n, '' AS mode, 0 AS blk FROM found UNION ALL SELECT doc_id, n, CASE WHEN stays THEN mode WHEN opens THEN 'table' ELSE 'text' END, CASE WHEN stays THEN blk ELSE blk + 1 END FROM
 (SELECT l.doc_id, l.n, l.opens, st.mode, st.blk, (st.mode = 'table' AND l.goes) OR (st.mode = 'text' AND NOT l.opens) AS stays FROM st JOIN l ON l.doc_id = st.doc_id AND l.n = st.n + 1)),
 b AS (SELECT doc_id, blk, any_value(mode) AS type, {sql_strip("string_agg(line, chr(10) ORDER BY n)")} AS content FROM st JOIN l USING (doc_id, n) GROUP BY 1, 2
 UNION ALL SELECT doc_id, 1, 'text', {sql_strip('text')} FROM ({TABLE_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM found))
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY blk) - 1)::INT AS block, type, content FROM b WHERE content <> ''"""


@add("content_blocks", BLOCKS_SQL)
def _(spark, sf):
    docs = table_docs(spark, sf)
    kind = F.get(S.table_ranges(F.col("text")), F.lit(0))["table_type"]
    return (docs.select("doc_id", F.posexplode(S.content_blocks(F.col("text"), kind)).alias("block", "_b"))
            .select("doc_id", "block", "_b.type", "_b.content"))


@add("split_sentences", f"""SELECT doc_id, (generate_subscripts({SENTENCES.format('text')}, 1) - 1)::INT AS sentence_no,
 unnest({SENTENCES.format('text')}) AS sentence FROM documents""")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(T.split_sentences("text")).alias("sentence_no", "sentence"))


@add("split_paragraphs", f"""SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS paragraph_no, paragraph
 FROM (SELECT conv_id, turn, generate_subscripts(p, 1) AS i, {sql_strip('unnest(p)')} AS paragraph FROM
 (SELECT *, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n') AS p FROM conversations)) WHERE paragraph <> ''""")
def _(spark, sf):
    turns = load(spark, sf, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return turns.select("conv_id", "turn", F.posexplode(T.split_paragraphs("text")).alias("paragraph_no", "paragraph"))


@add("count_tokens", f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.count_tokens("text").alias("tokens"))


@add("estimate_chunks", f"SELECT doc_id, greatest(1, {TOKENS.format('text')} // 100)::INT AS estimate FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.estimate_chunks("text", 120, 20).alias("estimate"))


# sentences are handled one number at a time for all documents; a chunk is a list of sentences
PACK_SQL = f"""WITH RECURSIVE u AS (SELECT doc_id, generate_subscripts(x, 1)::BIGINT AS n, unnest(x) AS s FROM
 (SELECT doc_id, {SENTENCES.format(sql_strip('text'))} AS x FROM documents WHERE {sql_strip('text')} <> '')),
 t AS (SELECT *, {TOKENS.format('s')} AS t, count(*) OVER (PARTITION BY doc_id) AS last FROM u),
 st AS (SELECT doc_id, 0::BIGINT AS n, []::VARCHAR[] AS cur, []::INT[] AS cts, []::VARCHAR[] AS done, NULL::INT AS done_tokens FROM (SELECT DISTINCT doc_id FROM u)
 UNION ALL SELECT doc_id, n, CASE WHEN full_ THEN list_append(list_slice(cur, len(cur) - keep + 1, len(cur)), s) ELSE list_append(cur, s) END,
 CASE WHEN full_ THEN list_append(list_slice(cts, len(cts) - keep + 1, len(cts)), t) ELSE list_append(cts, t) END,
 CASE WHEN full_ THEN cur ELSE []::VARCHAR[] END, CASE WHEN full_ THEN list_sum(cts)::INT END FROM
 (SELECT t.doc_id, t.n, t.s, t.t, st.cur, st.cts, coalesce(list_sum(st.cts), 0) + t.t > 120 AND len(st.cur) > 0 AS full_,
 len(list_filter(range(1, len(st.cts) + 1), lambda k: list_sum(list_slice(st.cts, len(st.cts) - k + 1, len(st.cts))) <= 20)) AS keep
 FROM st JOIN t ON t.doc_id = st.doc_id AND t.n = st.n + 1)),
 out AS (SELECT doc_id, n, array_to_string(done, ' ') AS text, done_tokens AS token_count FROM st WHERE len(done) > 0
 UNION ALL SELECT st.doc_id, st.n + 1, array_to_string(st.cur, ' '), list_sum(st.cts)::INT FROM st JOIN (SELECT DISTINCT doc_id, last FROM t) m
 ON st.doc_id = m.doc_id AND st.n = m.last)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS chunk_index, text, token_count FROM out"""


def packed_documents(spark, sf):
    block = F.array(F.struct(F.lit("text").alias("type"), T.strip("text").alias("content")))
    return (documents(spark, sf).filter(T.strip("text") != "")
            .select("doc_id", F.posexplode(P.pack_sentences(block, 120, 20)).alias("chunk_index", "_c"))
            .select("doc_id", "chunk_index", "_c.text", "_c.token_count"))


@add("pack_sentences", PACK_SQL)
def _(spark, sf):
    return packed_documents(spark, sf)


@add("overlap_tail", f"""SELECT doc_id, array_to_string(list_slice(x, len(x) - keep + 1, len(x)), ' ') AS tail FROM (SELECT doc_id, x,
 len(list_filter(range(1, len(x) + 1), lambda k: list_sum(list_transform(list_slice(x, len(x) - k + 1, len(x)), lambda s: {TOKENS.format('s')})) <= 30)) AS keep
 FROM (SELECT doc_id, list_slice(x, greatest(len(x) - 40, 1), len(x)) AS x FROM (SELECT doc_id, {SENTENCES.format('text')} AS x FROM documents)))""")
def _(spark, sf):
    units = F.transform(T.split_sentences("text"), lambda s: F.struct(
        s.alias("content"), T.count_tokens(s).alias("t"), F.rlike(s, F.lit(r"[.!?]$")).alias("ends")))
    docs = documents(spark, sf).select("doc_id", units.alias("u"))
    from corpusq.functions.arrays import at, indexes, let
    tail = let(F.col("u"), lambda u: F.transform(P.overlap_units(indexes(u), u, 30), lambda i: at(u, i)["content"]))
    return docs.select("doc_id", F.array_join(tail, " ").alias("tail"))


# greedy packing of paragraphs, one carried over
def _greedy_sql(units, size, carry, glue, key):
    return f"""WITH RECURSIVE u AS ({units}), t AS (SELECT *, {TOKENS.format('s')} AS t, max(n) OVER (PARTITION BY {key}) AS last FROM u),
 st AS (SELECT {key}, 0::BIGINT AS n, []::VARCHAR[] AS cur, []::INT[] AS cts, []::VARCHAR[] AS done, NULL::INT AS done_tokens FROM (SELECT DISTINCT {key} FROM u)
 UNION ALL SELECT {key}, n, CASE WHEN NOT full_ THEN list_append(cur, s) WHEN len(cur) > {carry} THEN list_append(list_slice(cur, len(cur) - {carry} + 1, len(cur)), s) ELSE [s] END,
 CASE WHEN NOT full_ THEN list_append(cts, t) WHEN len(cur) > {carry} THEN list_append(list_slice(cts, len(cts) - {carry} + 1, len(cts)), t) ELSE [t] END,
 CASE WHEN full_ THEN cur ELSE []::VARCHAR[] END, CASE WHEN full_ THEN list_sum(cts)::INT END FROM
 (SELECT t.*, st.cur, st.cts, coalesce(list_sum(st.cts), 0) + t.t > {size} AND len(st.cur) > 0 AS full_ FROM st JOIN t ON t.{key} = st.{key} AND t.n = st.n + 1)),
 out AS (SELECT {key}, n, array_to_string(done, {glue}) AS text, done_tokens AS token_count FROM st WHERE len(done) > 0
 UNION ALL SELECT st.{key}, st.n + 1, array_to_string(st.cur, {glue}), list_sum(st.cts)::INT FROM st JOIN (SELECT DISTINCT {key}, last FROM t) m
 ON st.{key} = m.{key} AND st.n = m.last)
 SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY n) - 1)::INT AS chunk_index, text, token_count FROM out"""


@add("pack_paragraphs", _greedy_sql(
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, s FROM (SELECT doc_id, generate_subscripts(x, 1) AS i, {sql_strip('unnest(x)')} AS s FROM
 (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n') AS x FROM documents)) WHERE s <> ''""",
    80, 1, "chr(10) || chr(10)", "doc_id"))
def _(spark, sf):
    content = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return (documents(spark, sf).select("doc_id", F.posexplode(P.pack_paragraphs(content, 80)).alias("chunk_index", "_c"))
            .select("doc_id", "chunk_index", "_c.text", "_c.token_count"))


@add("pack_sentences_tail", _greedy_sql(
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, s FROM (SELECT doc_id, generate_subscripts(x, 1) AS i, {sql_strip('unnest(x)')} AS s FROM
 (SELECT doc_id, {SENTENCES.format('text')} AS x FROM documents)) WHERE s <> ''""", 60, 2, "' '", "doc_id"))
def _(spark, sf):
    return (documents(spark, sf).select("doc_id", F.posexplode(P.pack_sentences_tail(F.col("text"), 60)).alias("chunk_index", "_c"))
            .select("doc_id", "chunk_index", "_c.text", "_c.token_count"))


@add("split_large_table", f"""WITH l AS ({line_rows(TABLE_SQL, 'doc_id')}),
 k AS (SELECT *, contains(line, '|') AND {sql_any('lower(line)', fv.TABLE_HEADER_WORDS)} AS head,
 contains(line, '|') OR regexp_matches(line, '\\d+[PS]|\\d+¥') AS data FROM l),
 d AS (SELECT doc_id, line, n, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) // 10 AS grp FROM k WHERE data AND NOT head),
 h AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS head FROM k WHERE head GROUP BY 1)
 SELECT doc_id, grp::INT AS chunk_index, coalesce(any_value(h.head) || chr(10), '') || string_agg(line, chr(10) ORDER BY n) AS text
 FROM d LEFT JOIN h USING (doc_id) GROUP BY 1, 2""")
def _(spark, sf):
    return (table_docs(spark, sf).select("doc_id", F.posexplode(P.split_large_table(F.col("text"))).alias("chunk_index", "_c"))
            .select("doc_id", "chunk_index", "_c.text"))


def _table_lines_sql(source, key, size, least):
    """One line of every text a step; a step may end a chunk (s, e, tok, kind, header) of lines s to e - 1."""
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT {key}, ls, list_transform(ls, lambda x: {TOKENS.format('x')}) AS ts, list_transform(ls, lambda x: {sql_strip('x')} = '') AS bl
 FROM (SELECT {key}, string_split(text, chr(10)) AS ls FROM ({source}))),
 st AS (SELECT {key}, 0::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS tok, false AS in_table, -1::BIGINT AS header, NULL::STRUCT(s BIGINT, e BIGINT, tok BIGINT, kind VARCHAR, header BIGINT) AS made FROM l
 UNION ALL SELECT {key}, i + 1, CASE WHEN act IN ('flush', 'leave') THEN i WHEN act = 'cut' THEN fresh ELSE start END,
 CASE WHEN act IN ('flush', 'leave') THEN t WHEN act = 'cut' THEN list_sum(ts[fresh + 1:i + 1])::BIGINT ELSE tok + t END,
 CASE WHEN act IN ('flush', 'enter') THEN true WHEN act IN ('leave', 'cut') THEN false ELSE in_table END,
 CASE WHEN act IN ('flush', 'enter') THEN i WHEN act = 'leave' THEN -1 ELSE header END,
 CASE act WHEN 'flush' THEN {{'s': start, 'e': i, 'tok': tok, 'kind': 'paragraph', 'header': -1::BIGINT}} WHEN 'leave' THEN {{'s': start, 'e': i, 'tok': tok, 'kind': 'table', 'header': -1::BIGINT}}
 WHEN 'cut' THEN {{'s': start, 'e': start + p, 'tok': list_sum(ts[start + 1:start + p])::BIGINT, 'kind': 'paragraph', 'header': -1::BIGINT}} END FROM
 (SELECT *, start + greatest(0, p - 2) AS fresh, CASE WHEN piped AND NOT in_table THEN CASE WHEN i > start AND tok > {least} THEN 'flush' ELSE 'enter' END WHEN in_table AND NOT piped AND NOT bl[i + 1] THEN 'leave'
 WHEN tok + t > {size} AND NOT in_table AND p > 0 THEN 'cut' ELSE 'grow' END AS act FROM
 (SELECT st.*, ls, ts, bl, ts[i + 1]::BIGINT AS t, contains(ls[i + 1], '|') AS piped,
 coalesce(list_max(list_filter(range(start + 1, i + 1), lambda k: bl[k + 1] OR bl[k])) - start, (i - start + 1) // 2) AS p FROM st JOIN l USING ({key}) WHERE i < len(ls)))),
 made AS (SELECT {key}, i, made FROM st WHERE made IS NOT NULL UNION ALL SELECT {key}, i + 1, {{'s': start, 'e': len(ls)::BIGINT, 'tok': tok, 'kind': CASE WHEN in_table THEN 'table' ELSE 'paragraph' END, 'header': header}}
 FROM st JOIN l USING ({key}) WHERE i = len(ls)),
 cut AS (SELECT {key}, i, {sql_strip("array_to_string(ls[made.s + 1:made.e], chr(10))")} AS text, made.tok::INT AS token_count, made.kind AS chunk_type,
 CASE WHEN made.header >= 0 THEN {sql_strip('ls[made.header + 1]')} END AS table_header FROM made JOIN l USING ({key}))
 SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY i) - 1)::INT AS chunk_index, text, token_count, chunk_type, table_header FROM cut WHERE text <> ''"""


@add("pack_table_lines", _table_lines_sql(TABLE_SQL, "doc_id", 120, 40))
def _(spark, sf):
    return (table_docs(spark, sf).select("doc_id", F.posexplode(P.pack_table_lines(F.col("text"), 120, 40)).alias("chunk_index", "_c"))
            .select("doc_id", "chunk_index", "_c.*"))


STARTS = f"regexp_matches({sql_strip('text')}, '^\\p{{Ll}}')"
ENDS = f"({sql_strip('text')} <> '' AND NOT regexp_matches({sql_strip('text')}, '[.!?]$'))"
QUALITY_SQL = f"CASE WHEN NOT {STARTS} AND NOT {ENDS} THEN 'excellent' WHEN NOT {STARTS} OR NOT {ENDS} THEN 'good' ELSE 'poor' END"


def pipes(expr, piece="'|'"):
    return f"((length({expr}) - length(replace({expr}, {piece}, ''))) // length({piece}))"


TABLE_LIKE_SQL = (f"(({pipes('text')} > 5 AND {pipes('text', chr(99) + 'hr(10) || ' + chr(39) + '|' + chr(39))} > 1) "
                  f"OR {sql_count('lower(text)', fv.TABLE_STAT_WORDS)} >= 3)")
CHUNK_TYPE_SQL = f"""CASE WHEN {TABLE_LIKE_SQL} THEN 'table' WHEN {sql_any('lower(text)', fv.RULE_TERMS)} THEN 'rule'
 WHEN {sql_any('lower(text)', fv.EXAMPLE_TERMS)} THEN 'example' WHEN {pipes('text', "chr(10) || '-'")} > 2 OR {pipes('text', "chr(10) || '•'")} > 2 THEN 'list'
 ELSE 'narrative' END"""
HAS_TABLES_SQL = f"""(({pipes('text')} >= 6 AND {pipes('text', "chr(10) || '|'")} >= 2) OR {sql_any('lower(text)', fv.TABLE_STAT_WORDS)})"""
# whole sections, sections with tables by their lines, others by their paragraphs
STRATEGY_SQL = f"""WITH sec AS MATERIALIZED (SELECT *, doc_id || ':' || section_index AS k, {TOKENS.format('text')} AS n, {HAS_TABLES_SQL} AS tables
 FROM (SELECT * RENAME (content AS text) FROM ({_semantic_sql(TABLE_SQL)}))),
 made AS (SELECT k, true AS is_complete_section, 0 AS chunk_index, text, n AS token_count, {CHUNK_TYPE_SQL} AS chunk_type, NULL AS table_header FROM sec WHERE n <= 120
 UNION ALL SELECT k, false, chunk_index, text, token_count, chunk_type, table_header FROM ({_table_lines_sql("SELECT k, text FROM sec WHERE n > 120 AND tables", "k", 120, fv.SEMANTIC_MIN_CHUNK)})
 UNION ALL SELECT k, false, chunk_index, text, token_count, 'paragraph', NULL FROM ({_greedy_sql(
     f"""SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS n, s FROM (SELECT k, generate_subscripts(x, 1) AS i, {sql_strip('unnest(x)')} AS s FROM
 (SELECT k, string_split_regex(text, '\\n\\s*\\n') AS x FROM sec WHERE n > 120 AND NOT tables)) WHERE s <> ''""", 120, 1, "chr(10) || chr(10)", "k")}))
 SELECT sec.doc_id, section_index, section_title, section_level, start_pos, line_start, line_end, m.* EXCLUDE (k), CASE WHEN is_complete_section THEN 'excellent' ELSE {QUALITY_SQL.replace('text', 'm.text')} END AS boundary_quality,
 {TABLE_LIKE_SQL.replace('(text', '(m.text')} AS is_table_content FROM made m JOIN sec USING (k)"""


@add("choose_strategy", STRATEGY_SQL)
def _(spark, sf):
    return P.chunk_semantic(S.split_semantic(table_docs(spark, sf).select("doc_id", "text")), 120)


def chunk_sql(source, size, overlap):
    """Sections, blocks, packing, ids and links of (doc_id, doc_path, text), one unit of every section a step."""
    stem, entry = "regexp_replace(regexp_extract(doc_path, '[^/]*$'), '[.][^.]*$', '')", "STRUCT(units BIGINT[], tok BIGINT, kind VARCHAR)"
    return f"""WITH RECURSIVE src AS MATERIALIZED ({source}), sec AS MATERIALIZED (SELECT *, doc_id || ':' || section_index AS k FROM ({headers_sql('SELECT * FROM src')})),
 found AS MATERIALIZED (SELECT doc_id, arg_min(table_type, start_line) AS first_type FROM ({tables_sql('SELECT * FROM src')}) GROUP BY 1),
 l AS MATERIALIZED (SELECT k, n, line, length(line) - length(replace(line, '|', '')) >= 2 OR {sql_any('lower(line)', fv.BLOCK_STAT_WORDS)} AS opens,
 contains(line, '|') OR {sql_strip('line')} = '' OR (first_type = 'weapon_stats' AND regexp_matches(line, '[\\d\\-]')) AS goes
 FROM (SELECT k, first_type, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM sec JOIN found USING (doc_id))),
 bs AS (SELECT k, 0::BIGINT AS n, '' AS mode, 0 AS blk FROM sec JOIN found USING (doc_id) UNION ALL
 SELECT k, n, CASE WHEN stays THEN mode WHEN opens THEN 'table' ELSE 'text' END, CASE WHEN stays THEN blk ELSE blk + 1 END FROM
 (SELECT l.k, l.n, l.opens, bs.mode, bs.blk, (bs.mode = 'table' AND l.goes) OR (bs.mode = 'text' AND NOT l.opens) AS stays FROM bs JOIN l ON l.k = bs.k AND l.n = bs.n + 1)),
 blocks AS (SELECT * FROM (SELECT k, blk, any_value(mode) AS type, {sql_strip("string_agg(line, chr(10) ORDER BY n)")} AS content FROM bs JOIN l USING (k, n) GROUP BY 1, 2
 UNION ALL SELECT k, 1, 'text', {sql_strip('content')} FROM sec WHERE doc_id NOT IN (SELECT doc_id FROM found)) WHERE content <> ''),
 pieces AS (SELECT k, blk, type = 'table' AS tab, unnest(x) AS content, generate_subscripts(x, 1) AS i FROM
 (SELECT *, CASE WHEN type = 'table' THEN [content] ELSE {SENTENCES.format('content')} END AS x FROM blocks)),
 u AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY blk, i) AS n, content, {TOKENS.format('content')} AS t, tab, count(*) OVER (PARTITION BY k) AS last FROM pieces),
 st AS (SELECT k, 0::BIGINT AS n, []::BIGINT[] AS cur, 0::BIGINT AS tok, []::BIGINT[] AS run, []::INT[] AS rt, false AS last_text, []::{entry}[] AS made FROM (SELECT DISTINCT k FROM u)
 UNION ALL SELECT k, n, CASE act WHEN 'split' THEN [] WHEN 'tfull' THEN [n] WHEN 'sfull' THEN list_append(list_slice(run, len(run) - keep + 1, len(run)), n) ELSE list_append(cur, n) END,
 CASE act WHEN 'split' THEN 0 WHEN 'tfull' THEN t WHEN 'sfull' THEN coalesce(list_sum(list_slice(rt, len(rt) - keep + 1, len(rt))), 0)::BIGINT + t ELSE tok + t END,
 CASE WHEN act IN ('split', 'tfull') THEN [] WHEN act = 'tadd' THEN run WHEN act = 'sfull' THEN list_append(list_slice(run, len(run) - keep + 1, len(run)), n) WHEN last_text THEN list_append(run, n) ELSE [n] END,
 CASE WHEN act IN ('split', 'tfull') THEN [] WHEN act = 'tadd' THEN rt WHEN act = 'sfull' THEN list_append(list_slice(rt, len(rt) - keep + 1, len(rt)), t) WHEN last_text THEN list_append(rt, t) ELSE [t] END,
 act IN ('sfull', 'sadd'),
 CASE WHEN act IN ('split', 'tfull') AND len(cur) > 0 THEN [{{'units': cur, 'tok': tok, 'kind': 'mixed'}}] WHEN act = 'sfull' THEN [{{'units': cur, 'tok': tok, 'kind': 'text'}}] ELSE []::{entry}[] END
 || CASE WHEN act = 'split' THEN [{{'units': [n], 'tok': t::BIGINT, 'kind': 'table_split'}}] ELSE []::{entry}[] END FROM
 (SELECT u.k, u.n, u.t, st.cur, st.tok, st.run, st.rt, st.last_text, len(list_filter(range(1, len(st.rt) + 1), lambda j: list_sum(list_slice(st.rt, len(st.rt) - j + 1, len(st.rt))) <= {overlap})) AS keep,
 CASE WHEN u.tab AND u.t > {size} THEN 'split' WHEN u.tab AND st.tok + u.t > {size} THEN 'tfull' WHEN u.tab THEN 'tadd' WHEN st.tok + u.t > {size} AND len(st.cur) > 0 THEN 'sfull' ELSE 'sadd' END AS act
 FROM st JOIN u ON u.k = st.k AND u.n = st.n + 1)),
 entries AS (SELECT k, n, i, made[i] AS e FROM (SELECT k, n, made, generate_subscripts(made, 1) AS i FROM st WHERE len(made) > 0)
 UNION ALL SELECT st.k, st.n + 1, 1, {{'units': cur, 'tok': tok, 'kind': 'text'}} FROM st JOIN (SELECT DISTINCT k, last FROM u) m ON st.k = m.k AND st.n = m.last WHERE len(cur) > 0),
 numbered AS (SELECT *, row_number() OVER () AS eid FROM entries),
 parts AS (SELECT *, lag(unit) OVER (PARTITION BY eid ORDER BY p) AS before FROM (SELECT eid, unnest(e.units) AS unit, generate_subscripts(e.units, 1) AS p, k FROM numbered)),
 glued AS (SELECT eid, string_agg(CASE WHEN p = 1 THEN '' WHEN u.tab OR b.tab THEN chr(10) || chr(10) ELSE ' ' END || u.content, '' ORDER BY p) AS text FROM parts q JOIN u ON u.k = q.k AND u.n = q.unit
 LEFT JOIN u b ON b.k = q.k AND b.n = q.before GROUP BY 1),
 tl AS (SELECT eid, line, row_number() OVER (PARTITION BY eid ORDER BY i) AS i, contains(line, '|') AND {sql_any('lower(line)', fv.TABLE_HEADER_WORDS)} AS head,
 contains(line, '|') OR regexp_matches(line, '\\d+[PS]|\\d+¥') AS data FROM (SELECT eid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
 FROM glued JOIN numbered USING (eid) WHERE e.kind = 'table_split')),
 heads AS (SELECT eid, string_agg(line, chr(10) ORDER BY i) AS head FROM tl WHERE head GROUP BY 1),
 rows AS (SELECT eid, line, i, (row_number() OVER (PARTITION BY eid ORDER BY i) - 1) // 10 AS grp FROM tl WHERE data AND NOT head),
 chunks AS (SELECT k, n, i, 0::BIGINT AS grp, text, e.tok::INT AS token_count, e.kind AS chunk_type FROM numbered JOIN glued USING (eid) WHERE e.kind <> 'table_split'
 UNION ALL SELECT k, n, i, grp, text, {TOKENS.format('text')}, 'table_split' FROM (SELECT eid, grp, coalesce(any_value(head) || chr(10), '') || string_agg(line, chr(10) ORDER BY r.i) AS text
 FROM rows r LEFT JOIN heads USING (eid) GROUP BY 1, 2) JOIN numbered USING (eid)),
 c AS (SELECT src.* EXCLUDE (text), section_index, section_title, section_level, (row_number() OVER s - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY k))::INT AS total_chunks_in_section,
 c.text, token_count, chunk_type, {stem} || '_section_' || section_index AS section_id FROM chunks c JOIN sec USING (k) JOIN src USING (doc_id) WINDOW s AS (PARTITION BY k ORDER BY n, i, grp)),
 ids AS (SELECT *, section_id || '_chunk_' || chunk_index AS chunk_id FROM c)
 SELECT *, section_index::BIGINT * 4294967296 + chunk_index AS chunk_pos, length(text)::INT AS char_count, chunk_type IN ('table', 'table_split') AS is_table_content,
 lag(chunk_id) OVER d AS prev_chunk_global, lead(chunk_id) OVER d AS next_chunk_global, CASE WHEN chunk_index > 0 THEN section_id || '_chunk_' || (chunk_index - 1) END AS prev_chunk_section,
 CASE WHEN chunk_index < total_chunks_in_section - 1 THEN section_id || '_chunk_' || (chunk_index + 1) END AS next_chunk_section, chunk_index = total_chunks_in_section - 1 AS section_complete,
 array_to_string(list_transform(list_slice(list_filter(range(0, least(total_chunks_in_section, 6)), lambda x: x <> chunk_index), 1, 5), lambda x: section_id || '_chunk_' || x), ',') AS section_chunk_ids
 FROM ids WINDOW d AS (PARTITION BY doc_id ORDER BY section_index, chunk_index)"""


@add("chunk_documents", chunk_sql(TABLE_SQL, 120, 20))
def _(spark, sf):
    return C.chunk_documents(table_docs(spark, sf), size=120, overlap=20).withColumn(
        "section_chunk_ids", F.array_join("section_chunk_ids", ","))


@add("chunk_id", """SELECT doc_id, 'doc-' || doc_id || '_section_' || doc_id % 7 || '_chunk_' || doc_id % 3 AS chunk_id,
 'doc-' || doc_id || '_' || doc_id % 3 || '_' || left(md5(text), 8) AS content_id FROM documents""")
def _(spark, sf):
    doc = F.col("doc_id")
    path = F.concat(F.lit("lib/doc-"), doc.cast("string"), F.lit(".md"))
    return documents(spark, sf).select("doc_id", C.chunk_id(path, doc % 7, doc % 3).alias("chunk_id"),
                                       C.content_chunk_id(path, doc % 3, F.col("text")).alias("content_id"))


LINKS_SQL = f"""SELECT chunk_id, lag(chunk_id) OVER g AS prev_chunk_global, lead(chunk_id) OVER g AS next_chunk_global,
 (count(*) OVER (PARTITION BY doc_path, section_index))::INT AS total_chunks_in_section,
 CASE WHEN lag(section_index) OVER g = section_index THEN lag(chunk_id) OVER g END AS prev_chunk_section,
 CASE WHEN lead(section_index) OVER g = section_index THEN lead(chunk_id) OVER g END AS next_chunk_section,
 coalesce(lead(section_index) OVER g, '') <> section_index AS section_complete, 'conv-' || conv_id || '_section_' || section_index AS section_id
 FROM ({CHUNKS_SQL}) WINDOW g AS (PARTITION BY doc_path ORDER BY chunk_pos)"""


@add("link_sequential", LINKS_SQL)
def _(spark, sf):
    linked = C.link_sequential(conversation_chunks(spark, sf))
    return linked.select("chunk_id", "prev_chunk_global", "next_chunk_global", "total_chunks_in_section",
                         "prev_chunk_section", "next_chunk_section", "section_complete", "section_id")


@add("link_siblings", f"""WITH c AS ({CHUNKS_SQL}) SELECT a.chunk_id, coalesce((SELECT string_agg(chunk_id, ',' ORDER BY chunk_pos) FROM
 (SELECT * FROM c b WHERE b.doc_path = a.doc_path AND b.section_index = a.section_index AND b.chunk_id <> a.chunk_id ORDER BY chunk_pos LIMIT 2)), '') AS siblings FROM c a""")
def _(spark, sf):
    return C.link_siblings(conversation_chunks(spark, sf), k=2).select(
        "chunk_id", F.array_join("section_chunk_ids", ",").alias("siblings"))


@add("link_table_continuations", f"""WITH c AS (SELECT *, turn % 2 = 0 AS is_table, CASE WHEN role <> 'user' THEN role END AS header FROM ({CHUNKS_SQL}))
 SELECT a.chunk_id, CASE WHEN a.is_table THEN coalesce((SELECT string_agg(chunk_id, ',' ORDER BY chunk_pos) FROM (SELECT * FROM c b
 WHERE b.doc_path = a.doc_path AND b.header IS NOT DISTINCT FROM a.header AND b.chunk_id <> a.chunk_id ORDER BY chunk_pos LIMIT 3)), '') END AS continuations FROM c a""")
def _(spark, sf):
    chunks = (conversation_chunks(spark, sf).withColumn("is_table_content", F.col("turn") % 2 == 0)
              .withColumn("table_header", F.when(F.col("role") != "user", F.col("role"))))
    return C.link_table_continuations(chunks).select(
        "chunk_id", F.array_join("table_continuation_ids", ",").alias("continuations"))


@add("boundary_quality", f"SELECT doc_id, {QUALITY_SQL} AS quality, {STARTS} AS starts_mid, {ENDS} AS ends_mid FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", Q.boundary_quality("text").alias("quality"),
                                       Q.starts_mid_sentence("text").alias("starts_mid"), Q.ends_mid_sentence("text").alias("ends_mid"))


@add("chunk_type", f"""SELECT doc_id, CASE WHEN {TABLE_LIKE_SQL} THEN 'table' WHEN {sql_any('lower(text)', fv.RULE_TERMS)} THEN 'rule'
 WHEN {sql_any('lower(text)', fv.EXAMPLE_TERMS)} THEN 'example' WHEN {pipes('text', "chr(10) || '-'")} > 2 OR {pipes('text', "chr(10) || '•'")} > 2 THEN 'list'
 ELSE 'narrative' END AS chunk_type FROM ({TABLE_SQL})""")
def _(spark, sf):
    return table_docs(spark, sf).select("doc_id", Q.chunk_type("text").alias("chunk_type"))


@add("is_table_content", f"""SELECT doc_id, {TABLE_LIKE_SQL} AS is_table,
 ({pipes('text')} >= 6 AND {pipes('text', "chr(10) || '|'")} >= 2) OR {sql_any('lower(text)', fv.TABLE_STAT_WORDS)} AS has_tables FROM ({TABLE_SQL})""")
def _(spark, sf):
    return table_docs(spark, sf).select("doc_id", Q.is_table_content("text").alias("is_table"), Q.contains_tables("text").alias("has_tables"))
