"""Sources, maintenance, cleaning and headings."""

from pyspark.sql import functions as F

from corpusq.checks.fixtures import (CHUNKS_SQL, DIRTY_SQL, MD_SQL, conversation_chunks, dirty_docs, documents,
                                     md_docs, sql_any, sql_strip)
from corpusq.checks.chunking import ENDS, QUALITY_SQL, STARTS, chunk_sql
from corpusq.checks.registry import Checks
from corpusq.functions import fixed_values as fv, text as T
from corpusq.operators import chunks as C, headings as H, maintenance as M
from corpusq.session import load, load_spread
from corpusq.sources import markdown as MD

checks = Checks()
add = checks.add

DOC_PATH_SQL = "'lib/' || source || '/doc-' || doc_id || '.md'"


def _paths(spark, sf):
    return documents(spark, sf).select(
        "doc_id", "source", "lang",
        F.concat(F.lit("lib/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"),
        "text")


# ---- sources ----------------------------------------------------------------------------
TERMS = ["erad", "tionn", "ouou"]


@add("filter_rulebook_docs", f"SELECT doc_id FROM documents WHERE length(text) >= 1000 AND {sql_any('lower(text)', TERMS)}")
def _(spark, sf):
    return M.filter_rulebook_docs(documents(spark, sf), indicators=TERMS).select("doc_id")


FRONT_SQL = f"""SELECT {DOC_PATH_SQL} AS doc_path, '---' || chr(10) || 'title: "' || left(replace(text, chr(10), ' '), 30) || '"'
 || chr(10) || 'edition: "' || lang || '"' || chr(10) || 'section_number: ' || doc_id || chr(10) || '---' || chr(10)
 || chr(10) || text AS text, text AS raw, left(replace(text, chr(10), ' '), 30) AS head, lang, doc_id FROM documents"""


def _front_docs(spark, sf):
    head = F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(30))
    return _paths(spark, sf).select("doc_path", F.concat(
        F.lit('---\ntitle: "'), head, F.lit('"\nedition: "'), "lang", F.lit('"\nsection_number: '),
        F.col("doc_id").cast("string"), F.lit("\n---\n\n"), "text").alias("text"))


@add("parse_front_matter", f"""SELECT doc_path, head AS title, lang AS edition,
 doc_id::VARCHAR AS section_number, regexp_replace(raw, '^\\s+', '') AS body FROM ({FRONT_SQL})""")
def _(spark, sf):
    parsed = MD.parse_front_matter(_front_docs(spark, sf))
    return parsed.select("doc_path", *[F.col("meta")[k].alias(k) for k in ("title", "edition", "section_number")], "body")


def _title_case(expr):
    chain = "CASE"
    for section, words in fv.TITLE_SECTIONS:
        chain += f" WHEN {sql_any(f'lower({expr})', words)} THEN '{section}'"
    return chain + " ELSE 'General' END"


SAFE_SQL = ("CASE WHEN {x} = '' THEN 'untitled' ELSE {x} END").replace(
    "{x}", "left(regexp_replace(regexp_replace(regexp_replace(title, '[<>:\"/\\\\|?*]', '', 'g'), '\\s+', '_', 'g'), "
           "'^[._]+|[._]+$', '', 'g'), 50)")

SECTION_ROWS_SQL = """SELECT source || '.pdf' AS source, doc_id AS section_number,
 left(replace(text, chr(10), ' '), 70) AS title, text AS content FROM documents"""


def _section_rows(spark, sf):
    return documents(spark, sf).select(
        F.concat("source", F.lit(".pdf")).alias("source"), F.col("doc_id").alias("section_number"),
        F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(70)).alias("title"), F.col("text").alias("content"))


@add("write_front_matter", f"""SELECT regexp_replace(source, '\\.pdf$', '') || '-' ||
 CASE WHEN length(section_number::VARCHAR) < 2 THEN '0' || section_number ELSE section_number::VARCHAR END
 || '-' || {SAFE_SQL} || '.md' AS file_name,
 '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'source: "' || source || '"' || chr(10)
 || 'section_number: ' || section_number || chr(10) || 'primary_section: "' || {_title_case('title')} || '"' || chr(10)
 || 'extraction_method: "toc_guided"' || chr(10) || 'edition: "sr5"' || chr(10) || 'document_type: "rulebook"' || chr(10)
 || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || content AS text FROM ({SECTION_ROWS_SQL})""")
def _(spark, sf):
    return MD.write_front_matter(_section_rows(spark, sf))


@add("safe_file_name", f"SELECT section_number, {SAFE_SQL} AS safe_title FROM ({SECTION_ROWS_SQL})")
def _(spark, sf):
    return _section_rows(spark, sf).select("section_number", T.safe_file_title("title").alias("safe_title"))


@add("content_fingerprint", "SELECT doc_id, md5(text) AS hash, strlen(text)::INT AS file_size FROM documents")
def _(spark, sf):
    return M.fingerprint(documents(spark, sf), "doc_id")


# ---- maintenance --------------------------------------------------------------------------
# the manifest knows two thirds of the paths, some with an old hash, and paths that are gone
MANIFEST_SQL = f"""SELECT CASE WHEN doc_id % 7 = 0 THEN 'gone/' || doc_id ELSE {DOC_PATH_SQL} END AS doc_path,
 CASE WHEN doc_id % 5 = 0 THEN md5(lang) ELSE md5(text) END AS hash FROM documents WHERE lang <> 'fr'"""


def _manifest(spark, sf):
    docs = _paths(spark, sf).filter("lang <> 'fr'")
    return docs.select(
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("gone/"), F.col("doc_id").cast("string")))
        .otherwise(F.col("doc_path")).alias("doc_path"),
        F.when(F.col("doc_id") % 5 == 0, F.md5("lang")).otherwise(F.md5("text")).alias("hash"))


DIFF_SQL = f"""SELECT coalesce(n.doc_path, m.doc_path) AS doc_path, n.hash AS new_hash, m.hash AS old_hash,
 CASE WHEN n.hash IS NULL THEN 'orphan' WHEN m.hash IS NULL THEN 'new' WHEN n.hash <> m.hash THEN 'changed'
 ELSE 'unchanged' END AS status
 FROM (SELECT {DOC_PATH_SQL} AS doc_path, md5(text) AS hash FROM documents) n
 FULL OUTER JOIN ({MANIFEST_SQL}) m ON n.doc_path = m.doc_path"""


def _diff(spark, sf):
    return M.diff_manifest(M.fingerprint(_paths(spark, sf)), _manifest(spark, sf))


@add("diff_manifest", DIFF_SQL)
def _(spark, sf):
    return _diff(spark, sf)


@add("upsert_chunks", f"""WITH d AS ({DIFF_SQL}), store AS (SELECT {DOC_PATH_SQL} AS doc_path, 'old' AS version,
 md5(lang || text) AS body FROM documents UNION ALL SELECT doc_path, 'old', hash FROM ({MANIFEST_SQL}) WHERE doc_path LIKE 'gone/%'),
 fresh AS (SELECT p.doc_path, 'new' AS version, md5(p.text) AS body FROM (SELECT {DOC_PATH_SQL} AS doc_path, text FROM documents) p
 JOIN d ON p.doc_path = d.doc_path AND d.status IN ('new', 'changed'))
 SELECT * FROM store WHERE doc_path NOT IN (SELECT doc_path FROM fresh)
 AND doc_path NOT IN (SELECT doc_path FROM d WHERE status = 'orphan') UNION ALL SELECT * FROM fresh""")
def _(spark, sf):
    docs = _paths(spark, sf)
    old = docs.select("doc_path", F.lit("old").alias("version"), F.md5(F.concat("lang", "text")).alias("body"))
    gone = (_manifest(spark, sf).filter("doc_path LIKE 'gone/%'")
            .select("doc_path", F.lit("old").alias("version"), F.col("hash").alias("body")))
    status = _diff(spark, sf)
    fresh = (docs.join(status.filter(F.col("status").isin("new", "changed")).select("doc_path"), "doc_path", "left_semi")
             .select("doc_path", F.lit("new").alias("version"), F.md5("text").alias("body")))
    return M.upsert_chunks(old.unionByName(gone), fresh, status.filter("status = 'orphan'"))


@add("update_manifest", f"""SELECT doc_path, md5(string_agg(text, '' ORDER BY chunk_pos)) AS hash,
 sum(strlen(text))::BIGINT AS file_size, count(*) AS chunk_count, count(*) FILTER (role = 'user') AS table_chunks,
 count(*) FILTER (role <> 'user') AS text_chunks, 'now' AS indexed_at FROM ({CHUNKS_SQL}) GROUP BY doc_path""")
def _(spark, sf):
    chunks = conversation_chunks(spark, sf).withColumn("is_table_content", F.col("role") == "user")
    listing = chunks.groupBy("doc_path").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_pos", "text"))),
                                       lambda p: p["text"]), "")).alias("hash"),
        F.sum(F.octet_length("text")).alias("file_size"))
    return M.update_manifest(chunks, listing, F.lit("now"))


@add("index_run_summary", f"""WITH s AS (SELECT {DOC_PATH_SQL} AS doc_path, CASE WHEN doc_id % 11 = 0 THEN 'failed'
 WHEN doc_id % 2 = 0 THEN 'skipped' ELSE 'indexed' END AS status, 'Failed: ' || doc_id AS error, length(text) % 3 AS entities
 FROM documents) SELECT count(*) AS total_files, count(*) FILTER (status = 'indexed') AS indexed_files,
 count(*) FILTER (status = 'skipped') AS skipped_files, count(*) FILTER (status = 'failed') AS failed_files,
 sum(entities)::BIGINT AS entities_extracted, count(*) FILTER (entities > 0) AS files_with_entities,
 (SELECT string_agg(error, '; ' ORDER BY doc_path) FROM (SELECT * FROM s WHERE status = 'failed' ORDER BY doc_path LIMIT 3)) AS errors
 FROM s""")
def _(spark, sf):
    doc = F.col("doc_id")
    statuses = _paths(spark, sf).select(
        "doc_path", F.when(doc % 11 == 0, "failed").when(doc % 2 == 0, "skipped").otherwise("indexed").alias("status"),
        F.concat(F.lit("Failed: "), doc.cast("string")).alias("error"), (F.length("text") % 3).alias("entities"))
    return M.index_run_summary(statuses).withColumn("errors", F.array_join("errors", "; "))


@add("normalise_metadata", """SELECT event_id, user_id || ', ' || event_type AS tags, CASE WHEN event_id % 3 <> 0 THEN
 '{"k":"' || user_id || '"}' END AS props, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM events""")
def _(spark, sf):
    events = load(spark, sf, "events")
    user = F.col("user_id").cast("string")
    rows = events.select(
        "event_id", F.array(user, F.col("event_type")).alias("tags"),
        F.when(F.col("event_id") % 3 == 0, F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("k"), user)).alias("props"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"))
    flat = M.normalise_metadata(rows, arrays=["tags"], maps=["props"], scalars=["kind"])
    return flat.select("event_id", *[F.col("metadata")[k].alias(k) for k in ("tags", "props", "kind")])


@add("list_documents", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def _(spark, sf):
    return M.distinct_values(load(spark, sf, "documents"), "source")


@add("get_document", f"SELECT doc_path, text FROM (SELECT {DOC_PATH_SQL} AS doc_path, text FROM documents) WHERE doc_path = 'lib/src3/doc-3.md'")
def _(spark, sf):
    return M.get_document(_paths(spark, sf), "lib/src3/doc-3.md").select("doc_path", "text")


# ---- table of contents -----------------------------------------------------------------------
# an order is a document, its lines are the entries
TOC_SQL = """SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS seq,
 (l_partkey % 3 + 1)::INT AS level, 'Part ' || l_partkey AS title, l_linenumber * 2 AS page FROM lineitem"""


def _toc(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("seq"),
        (F.col("l_partkey") % 3 + 1).cast("int").alias("level"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        (F.col("l_linenumber") * 2).alias("page"))


@add("toc_hierarchy", f"""WITH t AS ({TOC_SQL}) SELECT doc, seq::INT AS seq, level, title, page,
 (SELECT arg_max(p.title, p.seq) FROM t p WHERE p.doc = t.doc AND p.seq < t.seq AND p.level < t.level) AS parent,
 (SELECT arg_max(p.title, p.seq) FROM t p WHERE p.doc = t.doc AND p.seq <= t.seq AND p.level = 1) AS section FROM t""")
def _(spark, sf):
    return H.toc_hierarchy(_toc(spark, sf))


RANGES_SQL = f"""SELECT doc, seq::INT AS seq, level, title, page, page AS start_page,
 (least(coalesce(lead(page) OVER (PARTITION BY doc ORDER BY seq), 20), 20) - 1)::INT AS end_page FROM ({TOC_SQL})"""


@add("toc_page_ranges", RANGES_SQL)
def _(spark, sf):
    toc = _toc(spark, sf)
    counts = toc.select("doc").distinct().withColumn("page_count", F.lit(20))
    return H.toc_page_ranges(toc, counts)


# a conversation is a document, turns are its pages, system and user turns start sections
SECTION_TOC_SQL = """SELECT conv_id AS doc, turn AS seq, CASE role WHEN 'system' THEN 1 ELSE 2 END AS level,
 role || ' ' || turn AS title, turn AS page FROM conversations WHERE role <> 'assistant'"""


@add("assemble_section_text", f"""WITH r AS (SELECT doc, seq, title, page AS s, least(coalesce(lead(page) OVER
 (PARTITION BY doc ORDER BY seq), n), n) - 1 AS e FROM ({SECTION_TOC_SQL}) JOIN (SELECT conv_id AS doc, max(turn) + 1 AS n
 FROM conversations GROUP BY 1) USING (doc)) SELECT doc, seq, title, 0::BIGINT AS part,
 string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM r JOIN conversations ON conv_id = doc AND turn BETWEEN s AND e
 WHERE {sql_strip('text')} <> '' GROUP BY ALL""")
def _(spark, sf):
    turns = load(spark, sf, "conversations")
    toc = turns.filter("role <> 'assistant'").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "system", 1).otherwise(2).alias("level"),
        F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("title"), F.col("turn").alias("page"))
    counts = turns.groupBy(F.col("conv_id").alias("doc")).agg((F.max("turn") + 1).alias("page_count"))
    pages = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return H.assemble_section_text(pages, H.toc_page_ranges(toc, counts))


HEADER_ROWS_SQL = f"""SELECT doc_id, doc_path, source, n - 1 AS line_no, line, length(regexp_extract(s, '^(#+)', 1))::INT AS level,
 {sql_strip("regexp_replace(s, '^#+', '')")} AS title FROM (SELECT *, {sql_strip('line')} AS s FROM (SELECT doc_id, doc_path, source,
 unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ({MD_SQL})))
 WHERE regexp_matches(s, '^#{{1,6}}\\s*[^#\\s]')"""


@add("extract_headers", f"SELECT doc_path, line_no::INT AS line_no, level, title FROM ({HEADER_ROWS_SQL})")
def _(spark, sf):
    return H.extract_headers(md_docs(spark, sf)).drop("_line")


def _norm_sql(expr):
    word = (f"CASE WHEN length(w) > 3 OR upper(w) IN ('AND', 'THE', 'FOR', 'WITH') THEN replace(upper(left(w, 1)), 'ẞ', 'Ss') || lower(substr(w, 2))"
            f" WHEN upper(w) IN {tuple(fv.ROMAN_NUMERALS)} THEN upper(w) ELSE lower(w) END")
    return (f"array_to_string(list_transform(string_split_regex({expr}, '\\s+'), lambda w: "
            f"CASE WHEN upper(w) IN {tuple(fv.ROMAN_NUMERALS)} THEN upper(w) ELSE {word} END), ' ')")


@add("normalise_title", f"""SELECT p_partkey, CASE p_name WHEN 'small ring' THEN 'Small Ring!' ELSE
 {_norm_sql("p_name || ' vii ' || lower(p_type)")} END AS title FROM part""")
def _(spark, sf):
    name = F.when(F.col("p_name") == "small ring", F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" vii "), F.lower("p_type")))
    return load(spark, sf, "part").select(
        "p_partkey", T.normalise_title(name, variations={"small ring": "Small Ring!"}).alias("title"))


# every second header title of a document is in the table of contents
FIX_TOC_SQL = f"""SELECT source, doc_id * 100000 + line_no AS seq, (line_no % 3 + 1)::INT AS level,
 title FROM ({HEADER_ROWS_SQL}) WHERE line_no % 2 = 0"""


def _fix_toc(spark, sf):
    docs = md_docs(spark, sf)
    heads = H.extract_headers(docs, keep=("doc_id", "source")).filter("line_no % 2 = 0")
    return heads.select("source", (F.col("doc_id") * 100000 + F.col("line_no")).alias("seq"),
                        (F.col("line_no") % 3 + 1).cast("int").alias("level"), "title")


def _fix_sql(hints):
    """Levels are looked up in the hinted section of the file first, then anywhere."""
    names = ", ".join(f"({i}, '{piece}', '{name.lower()}')" for i, (piece, name) in enumerate(hints))
    return f"""WITH toc AS ({FIX_TOC_SQL}), placed AS (SELECT *, {_norm_sql('title')} AS norm,
 last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq) AS section FROM toc),
 hints(place, piece, wanted) AS (VALUES {names}),
 owners AS (SELECT source, place, piece, arg_min(title, seq) AS section FROM toc, hints WHERE level = 1 AND contains(lower(title), wanted) GROUP BY ALL),
 chosen AS (SELECT doc_path, arg_min(o.section, o.place) AS section FROM ({MD_SQL}) d JOIN owners o ON d.source = o.source
  AND contains(lower(regexp_extract(d.doc_path, '[^/]*$')), o.piece) GROUP BY 1),
 inner_levels AS (SELECT source, section, norm, arg_min(level, seq) AS level FROM placed WHERE section IS NOT NULL GROUP BY ALL),
 anywhere AS (SELECT source, title AS norm, arg_max(level, seq) AS any_level FROM toc GROUP BY 1, 2),
 valid AS (SELECT source, title AS norm FROM toc UNION SELECT source, {_norm_sql('title')} FROM toc),
 h AS (SELECT *, {_norm_sql('title')} AS norm FROM ({HEADER_ROWS_SQL})),
 leveled AS (SELECT h.*, v.norm IS NOT NULL AS known, coalesce(i.level, a.any_level) AS new_level FROM h LEFT JOIN valid v ON h.source = v.source AND h.norm = v.norm
 LEFT JOIN anywhere a ON h.source = a.source AND h.norm = a.norm LEFT JOIN chosen c ON h.doc_path = c.doc_path
 LEFT JOIN inner_levels i ON h.source = i.source AND c.section = i.section AND h.norm = i.norm),
 fixed AS (SELECT doc_path, line_no, CASE WHEN NOT known THEN title WHEN new_level IS NULL THEN line
 WHEN {sql_strip('line')} = repeat('#', new_level) || ' ' || norm THEN line ELSE repeat('#', new_level) || ' ' || norm END AS line FROM leveled),
 l AS (SELECT doc_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
 FROM ({MD_SQL})) SELECT l.doc_path, string_agg(coalesce(f.line, l.line), chr(10) ORDER BY l.line_no) AS text FROM l
 LEFT JOIN fixed f ON l.doc_path = f.doc_path AND l.line_no = f.line_no GROUP BY 1"""


@add("fix_headers", _fix_sql([("no such file", "x")]))
def _(spark, sf):
    return H.fix_headers(md_docs(spark, sf), _fix_toc(spark, sf), hints=[("no such file", "x")]).select("doc_path", "text")


# the first hint names no section, the others name pieces of real ones
SECTION_HINTS = [("doc-", "no such section"), ("doc-1", "Ing"), ("2", "er"), ("doc-", "e")]


@add("fix_headers_sections", _fix_sql(SECTION_HINTS))
def _(spark, sf):
    return H.fix_headers(md_docs(spark, sf), _fix_toc(spark, sf), hints=SECTION_HINTS).select("doc_path", "text")


# ---- cleaning -------------------------------------------------------------------------------------
def _re(expr, pattern, replacement=""):
    return f"regexp_replace({expr}, '{pattern.replace(chr(39), chr(39) * 2)}', '{replacement}', 'g')"


def _replace_all(expr, pairs):
    for old, new in pairs:
        expr = f"replace({expr}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return expr


def _pages(expr):
    for pattern in fv.PAGE_REFERENCES:
        expr = _re(expr, pattern)
    return expr


RULES_SQL = {
    "hold_nav_markers": lambda e: _re(e, fv.NAV_MARKER, " \\1 \\2"),
    "strip_tags": lambda e: _re(e, fv.TAG),
    "release_nav_markers": lambda e: _re(e, "\\s+([^>]+?)\\s+(\\d+)", "<< \\1 \\2"),
    "remove_page_references": _pages,
    "remove_image_references": lambda e: _re(e, fv.IMAGE_REFERENCE),
    "remove_breadcrumbs": lambda e: _re(e, "(?m)" + fv.BREADCRUMB_LINE),
    "remove_escaped_references": lambda e: _re(e, fv.ESCAPED_CROSS_REFERENCE),
    "remove_bold_references": lambda e: _re(e, fv.BOLD_PAGE_REFERENCE),
    "remove_quote_only_lines": lambda e: _re(e, "(?m)" + fv.QUOTE_ONLY_LINE),
    "remove_simple_references": lambda e: _re(e, fv.SIMPLE_PAGE_REFERENCE),
    "repair_mojibake": lambda e: _replace_all(e, fv.MOJIBAKE),
    "squeeze_whitespace": lambda e: sql_strip(_re(_re(_re(e, "\\n\\s*\\n\\s*\\n+", "\n\n"), "[ \\t]+", " "), "(?m)[ \\t]+$")),
}


def clean_sql(expr):
    for step in T.CLEANING_STEPS:
        expr = RULES_SQL[step.__name__](expr)
    return expr


def _add_rule(name, step):
    @add(name, f"SELECT doc_id, {RULES_SQL[name]('text')} AS text FROM ({DIRTY_SQL})")
    def _(spark, sf):
        return dirty_docs(spark, sf).select("doc_id", step("text").alias("text"))


for _step in T.CLEANING_STEPS:
    if _step.__name__ not in ("hold_nav_markers", "release_nav_markers"):
        _add_rule(_step.__name__, _step)


@add("protect_nav_markers", f"""SELECT doc_id, {RULES_SQL['release_nav_markers'](RULES_SQL['strip_tags'](
    RULES_SQL['hold_nav_markers']('text')))} AS text FROM ({DIRTY_SQL})""")
def _(spark, sf):
    text = T.release_nav_markers(T.strip_tags(T.hold_nav_markers("text")))
    return dirty_docs(spark, sf).select("doc_id", text.alias("text"))


@add("clean_documents", f"""SELECT * FROM (SELECT doc_id, (length(text) - length({clean_sql('text')}))::INT AS chars_removed,
 {clean_sql('text')} AS text FROM ({DIRTY_SQL})) WHERE text <> ''""")
def _(spark, sf):
    return C.clean_documents(dirty_docs(spark, sf)).select("doc_id", "chars_removed", "text")


@add("clean_pages", f"""SELECT * FROM (SELECT page_id, (length(html) - length({clean_sql('html')}))::INT AS chars_removed,
 {clean_sql('html')} AS html FROM pages) WHERE html <> ''""")
def _(spark, sf):
    return C.clean_documents(load_spread(spark, sf, "pages", "page_id"), "html").select("page_id", "chars_removed", "html")


# ---- the flagship: clean, section, pack, link, grade, count per language ---------------------------
FLAGSHIP_SQL = f"""SELECT lang, count(*) AS total_chunks, min(token_count) AS token_min, max(token_count) AS token_max, avg(token_count) AS token_avg,
 count(*) FILTER (q = 'excellent') AS excellent, count(*) FILTER (q = 'good') AS good, count(*) FILTER (q = 'poor') AS poor,
 (count(*) FILTER (q = 'excellent') * 3 + count(*) FILTER (q = 'good') * 2 + count(*) FILTER (q = 'poor')) / (count(*) * 3) * 100 AS quality_score,
 count(*) FILTER (is_table_content) AS table_chunks, count(*) FILTER (s OR e) AS poor_boundary_chunks
 FROM (SELECT *, {QUALITY_SQL} AS q, {STARTS} AS s, {ENDS} AS e FROM ({chunk_sql(f"""SELECT * FROM (SELECT doc_id, lang,
 'lib/' || source || '/doc-' || doc_id || '.md' AS doc_path, {clean_sql('text')} AS text FROM documents) WHERE text <> '' AND {sql_strip('text')} <> ''""", 120, 20)})) GROUP BY 1"""
