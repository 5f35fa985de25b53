"""Entities, registry and libraries over markdown built from the part table."""

from pyspark.sql import functions as F

from corpusq.checks.fixtures import documents, sql_any, sql_strip, sql_text
from corpusq.checks.labelling import QUESTIONS_SQL, questions, sql_list
from corpusq.checks.registry import Checks
from corpusq.functions import extensions as U, fixed_values as fv, scoring as SC, text as T
from corpusq.operators import entities as E, indexing as IX, libraries as L
from corpusq.plans.once import compute_once
from corpusq.session import load, load_spread

checks = Checks()
add = checks.add

# a third of the parts are weapons, a third spells, a third attack programs; one in ten texts is a plain note
CHUNKS_SQL = """SELECT 'part-' || p_partkey AS chunk_id, p_brand AS source, p_partkey, p_name, p_type, p_size, p_partkey % 3 AS kind, p_partkey % 10 = 9 AS plain,
 CASE WHEN p_partkey % 10 = 9 THEN 'A note on ' || p_name || '.' WHEN p_partkey % 3 = 0 THEN 'HEAVY PISTOLS' || chr(10) || '| WEAPON | ACC | DAMAGE | AP | MODE | RC | AMMO | AVAIL | COST |' || chr(10) || '|---|---|---|---|---|---|---|---|---|' || chr(10)
 || '| ' || p_name || ' | ' || p_size || ' (' || p_size || ') | ' || p_size || 'P | -1 | SA/BF | - | 15 (c) | ' || p_size || 'R |' || chr(10) || '| ' || p_type || ' mark | 4 | 7S (e) | - | FA | 1 | 30 | 9F | ' || p_size || '00 |' || chr(10)
 || '**' || upper(p_name) || ' line:** A ' || p_type || ' thing ' || p_size || '.' || chr(10) || '**Other:** none' || chr(10)
 WHEN p_partkey % 3 = 1 THEN upper(p_name) || ' (DIRECT)' || chr(10) || chr(10) || '**Type:** ' || CASE WHEN p_size % 2 = 0 THEN 'P' ELSE 'M' END || ' ; **Range:** LOS (' || p_size || ') ; ' || CASE WHEN p_size % 3 = 0 THEN '**Damage:** S ; ' ELSE '' END
 || '**Duration:** S ; **Drain:** F - ' || p_size || chr(10) || chr(10) || 'It burns ' || p_size || ' things.' || chr(10) || chr(10) || 'The end.'
 ELSE upper(p_name) || ' **Attack:** Host Rating x 2 v. Logic + ' || p_size || chr(10) || chr(10) || 'Effect of ' || p_type || '.' || chr(10) || chr(10) || 'The end.' END AS text FROM part"""


def chunks(spark, sf):
    return _chunks(load_spread(spark, sf, "part", "p_partkey"))


def _chunks(part):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name, kind = F.col("p_name"), F.col("p_type")
    weapon = F.concat(
        F.lit("HEAVY PISTOLS\n| WEAPON | ACC | DAMAGE | AP | MODE | RC | AMMO | AVAIL | COST |\n|---|---|---|---|---|---|---|---|---|\n| "), name, F.lit(" | "), size,
        F.lit(" ("), size, F.lit(") | "), size, F.lit("P | -1 | SA/BF | - | 15 (c) | "), size, F.lit("R |\n| "), kind, F.lit(" mark | 4 | 7S (e) | - | FA | 1 | 30 | 9F | "), size,
        F.lit("00 |\n**"), F.upper(name), F.lit(" line:** A "), kind, F.lit(" thing "), size, F.lit(".\n**Other:** none\n"))
    spell = F.concat(
        F.upper(name), F.lit(" (DIRECT)\n\n**Type:** "), F.when(F.col("p_size") % 2 == 0, "P").otherwise("M"), F.lit(" ; **Range:** LOS ("), size, F.lit(") ; "),
        F.when(F.col("p_size") % 3 == 0, "**Damage:** S ; ").otherwise(""), F.lit("**Duration:** S ; **Drain:** F - "), size, F.lit("\n\nIt burns "), size, F.lit(" things.\n\nThe end."))
    program = F.concat(F.upper(name), F.lit(" **Attack:** Host Rating x 2 v. Logic + "), size, F.lit("\n\nEffect of "), kind, F.lit(".\n\nThe end."))
    text = F.when(key % 10 == 9, F.concat(F.lit("A note on "), name, F.lit("."))).when(key % 3 == 0, weapon).when(key % 3 == 1, spell).otherwise(program)
    rows = part.select("*", F.concat(F.lit("part-"), key.cast("string")).alias("chunk_id"), F.col("p_brand").alias("source"))
    return compute_once(rows, "text", text).select("chunk_id", "source", "p_partkey", "p_name", "p_type", "p_size", "text")


NAME_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
MAKERS = ["widget", "ring", "economy"]
MAKER_CASE = "CASE " + " ".join(f"WHEN contains(lower(n), '{m}') THEN '{m.title()}'" for m in MAKERS) + " ELSE '' END"
WEAPONS_SQL = f"""SELECT *, 'Heavy Pistols' AS category, {MAKER_CASE} AS manufacturer FROM (
 SELECT chunk_id, source, 0 AS pos, p_name AS n, p_size || ' (' || p_size || ')' AS accuracy, p_size || 'P' AS damage, '-1' AS ap, 'SA/BF' AS mode, '-' AS rc, '15 (c)' AS ammo, p_size || 'R' AS avail, '' AS cost, 'A ' || p_type || ' thing ' || p_size || '.' AS description FROM c WHERE kind = 0 AND NOT plain
 UNION ALL SELECT chunk_id, source, 1, p_type || ' mark', '4', '7S (e)', '-', 'FA', '1', '30', '9F', p_size || '00', '' FROM c WHERE kind = 0 AND NOT plain)"""
WITH_C = f"WITH c AS ({CHUNKS_SQL})"
W_FIELDS = ", ".join(E.WEAPON_FIELDS)


@add("extract_weapon_rows", f"{WITH_C} SELECT chunk_id, source, pos, n AS name, {W_FIELDS}, category, manufacturer FROM ({WEAPONS_SQL})")
def _(spark, sf):
    return E.extract_weapon_rows(chunks(spark, sf), makers=MAKERS)


@add("attach_descriptions", f"{WITH_C} SELECT chunk_id, n AS name, description FROM ({WEAPONS_SQL})")
def _(spark, sf):
    rows = chunks(spark, sf)
    records = E.attach_descriptions(E.weapon_rows(F.col("text")), F.col("text"))
    return rows.select("chunk_id", F.explode(records).alias("w")).select("chunk_id", "w.name", "w.description")


def _first_sql(expr, rules, default):
    return "CASE " + " ".join(f"WHEN {sql_any(expr, terms)} THEN '{label}'" for label, terms in rules) + f" ELSE '{default}' END"


SPELLS_SQL = f"""SELECT chunk_id, source, 0 AS pos, {NAME_TITLE} AS name, CASE WHEN p_size % 2 = 0 THEN 'P' ELSE 'M' END AS spell_type, 'LOS (' || p_size || ')' AS range, CASE WHEN p_size % 3 = 0 THEN 'S' ELSE '' END AS damage,
 'S' AS duration, 'F - ' || p_size AS drain, {_first_sql('lower(p_name)', fv.SPELL_CATEGORIES, 'Unknown')} AS category, '' AS description FROM c WHERE kind = 1 AND NOT plain"""


@add("extract_spells_formal", f"{WITH_C} {SPELLS_SQL.replace(chr(39) * 2 + ' AS description', chr(39) + 'It burns ' + chr(39) + ' || p_size || ' + chr(39) + ' things.' + chr(39) + ' AS description')}")
def _(spark, sf):
    return E.extract_spells_formal(chunks(spark, sf))


IC_SQL = """SELECT chunk_id, source, 0 AS pos, upper(p_name) AS name, 'Host Rating x 2' AS attack_pattern, 'Logic + ' || p_size AS resistance_test, 'Effect of ' || p_type || '.' AS effect_description, 'IC' AS category FROM c WHERE kind = 2 AND NOT plain"""


@add("extract_ic_formal", f"{WITH_C} {IC_SQL}")
def _(spark, sf):
    return E.extract_ic_formal(chunks(spark, sf))


@add("extract_records", """SELECT 'part-' || p_partkey AS chunk_id, 0 AS record_no, upper(p_name) AS name, CASE p_partkey % 3 WHEN 1 THEN
 'spell_type=' || CASE WHEN p_size % 2 = 0 THEN 'P' ELSE 'M' END || ';range=LOS (' || p_size || ');damage=' || CASE WHEN p_size % 3 = 0 THEN 'S' ELSE '' END || ';duration=S;drain=F - ' || p_size
 ELSE 'attack_pattern=Host Rating x 2;resistance_test=Logic + ' || p_size END AS details FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 10 <> 9""")
def _(spark, sf):
    U.register_table_functions(spark)
    chunks(spark, sf).createOrReplaceTempView("extract_records_input")
    both = [spark.sql(f"SELECT t.chunk_id, r.* FROM extract_records_input t, LATERAL extract_records(t.text, '{kind}') r").select(
        "chunk_id", "record_no", "name", F.concat_ws(";", *[F.concat(F.lit(f"{f}="), F.col("details")[f]) for f in U.RECORD_FIELDS[kind][2][1:]]).alias("details"))
            for kind in ("spell", "ic")]
    return both[0].unionByName(both[1])


# the second word of a name is looked for in a text whose record stands under another heading
CONTEXT_TEXT = "UNKNOWN THING\nWhat a {} does. **Type:** P ; **Range:** LOS ; **Duration:** I ; **Drain:** F - 2\n"


@add("extract_spells_contextual", f"""WITH c AS ({CHUNKS_SQL}) SELECT chunk_id, {NAME_TITLE} AS name, 'P' AS spell_type, 'Unknown' AS range, 'Unknown' AS duration FROM c""")
def _(spark, sf):
    rows = chunks(spark, sf).withColumn("text", F.concat(
        F.lit("What a "), "p_name", F.lit(" does.\n1. **Type:** P ; **Range:** LOS ; **Duration:** I ; **Drain:** F - 2\n")))
    found = rows.withColumn("found", F.array("p_name"))
    listed = E.spells_contextual(F.col("text"), F.col("found"), F.filter(E.spells_formal(F.col("text")), lambda s: F.lit(False)))
    return found.select("chunk_id", F.explode(listed).alias("s")).select("chunk_id", "s.name", "s.spell_type", "s.range", "s.duration")


@add("extract_ic_contextual", f"""WITH c AS ({CHUNKS_SQL}) SELECT chunk_id, {NAME_TITLE} AS name, 'Host' AS attack_pattern, 'Unknown' AS resistance_test FROM c""")
def _(spark, sf):
    rows = chunks(spark, sf).withColumn("text", F.concat(F.lit("1 The "), "p_name", F.lit(" strikes: **Attack:** Host v. x\n")))
    listed = E.ic_contextual(F.col("text"), F.array("p_name"), F.filter(E.ic_formal(F.col("text")), lambda s: F.lit(False)))
    return rows.select("chunk_id", F.explode(listed).alias("s")).select("chunk_id", "s.name", "s.attack_pattern", "s.resistance_test")


@add("paragraph_after", f"""{WITH_C} SELECT chunk_id, CASE WHEN plain OR kind = 0 THEN '' WHEN kind = 1 THEN 'It burns ' || p_size || ' things.' ELSE 'Effect of ' || p_type || '.' END AS paragraph FROM c""")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", E.paragraph_after(F.col("p_name"), F.col("text")).alias("paragraph"))


@add("extract_entities", f"""{WITH_C} SELECT chunk_id, (CASE WHEN kind = 0 AND NOT plain THEN 2 ELSE 0 END)::BIGINT AS weapons, (CASE WHEN kind = 1 AND NOT plain THEN 1 ELSE 0 END)::BIGINT AS spells,
 (CASE WHEN kind = 2 AND NOT plain THEN 1 ELSE 0 END)::BIGINT AS ic_programs, NOT plain AS has_entities FROM c""")
def _(spark, sf):
    rows = chunks(spark, sf)
    return E.entity_counts(rows).select("chunk_id", "weapons", "spells", "ic_programs", "has_entities")


@add("reextract", f"""{WITH_C} SELECT count(*) AS chunks_processed, count(*) FILTER (NOT plain) AS chunks_with_new_entities, (2 * count(*) FILTER (kind = 0 AND NOT plain))::BIGINT AS weapons_found, (count(*) FILTER (kind = 1 AND NOT plain))::BIGINT AS spells_found,
 (count(*) FILTER (kind = 2 AND NOT plain))::BIGINT AS ic_programs_found, (2 * count(*) FILTER (kind = 0 AND NOT plain) + count(*) FILTER (kind > 0 AND NOT plain))::BIGINT AS total_entities_found FROM c WHERE p_partkey % 4 <> 0""")
def _(spark, sf):
    rows = chunks(spark, sf).withColumn("has_entities", F.col("p_partkey") % 4 == 0)
    return E.reextract_stats(E.reextract(rows)[1])


# the whole index path over the same texts as files; a ninth file is blank
INDEX_SQL = f"""WITH c AS (SELECT *, p_partkey % 9 = 5 AS blank FROM ({CHUNKS_SQL})), f AS (SELECT *, CASE WHEN plain OR blank THEN 0 WHEN kind = 0 THEN 2 ELSE 1 END AS n FROM c),
 edge AS (SELECT p_partkey, count(DISTINCT e) AS edges FROM (SELECT p_partkey, unnest(CASE WHEN plain OR blank THEN [] WHEN kind = 0 THEN [p_name, p_type || ' mark'] ELSE [p_name] END) AS e FROM c) GROUP BY 1)
 SELECT 'lib/' || p_brand || '/part-' || f.p_partkey || '.md' AS doc_path, 'part-' || f.p_partkey || '_section_0_chunk_0' AS chunk_id, 1::BIGINT AS chunk_count, 1::BIGINT AS text_chunks,
 n::BIGINT AS entities, coalesce(edges, 0)::BIGINT AS edges, length(p_name)::DOUBLE AS marker, CASE WHEN contains(lower(f.text), 'dice pool') THEN 'explicit_rule' ELSE 'narrative' END AS content_type,
 (SELECT count(*) FROM f WHERE NOT blank) AS indexed_files, (SELECT count(*) FROM f WHERE blank) AS skipped_files, (SELECT count(*) FROM f WHERE n > 0) AS files_with_entities
 FROM f JOIN part USING (p_partkey, p_name) LEFT JOIN edge ON edge.p_partkey = f.p_partkey WHERE NOT blank"""


def _first_line_length():
    return lambda texts: [[float(len(t))] for t in texts]


@add("index_documents", INDEX_SQL)
def _(spark, sf):
    rows = chunks(spark, sf)
    docs = rows.select(F.concat(F.lit("lib/"), "source", F.lit("/"), "chunk_id", F.lit(".md")).alias("doc_path"), "source", "p_name",
                       F.when(F.col("p_partkey") % 9 == 5, F.lit(" \n")).otherwise(F.col("text")).alias("text"))
    made = IX.index_documents(docs, U.register_embedder(_first_line_length, 1), lexicon=[], patterns=[])
    edges = made["edges"].groupBy("chunk_id").agg(F.count(F.lit(1)).alias("edges"))
    found = made["chunks"].join(edges, "chunk_id", "left").fillna(0, ["edges"])
    totals = {c: made["summary"].select(c).scalar() for c in ("indexed_files", "skipped_files", "files_with_entities")}
    return (found.select("doc_path", "chunk_id", "edges", "content_type", F.length("p_name").cast("double").alias("marker"))
            .join(made["manifest"].select("doc_path", "chunk_count", "text_chunks", "entities"), "doc_path").withColumns(totals))


# ---- registry --------------------------------------------------------------------------
@add("registry_upsert", "SELECT user_id AS name, event_type AS source, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1, 2")
def _(spark, sf):
    events = load(spark, sf, "events").select(F.col("user_id").alias("name"), F.col("event_type").alias("source"), "value", F.col("event_id").alias("seq"))
    return E.registry_upsert(events.filter("seq % 3 = 0"), events.filter("seq % 3 <> 0"))


EDGES_SQL = "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'weapon' WHEN 1 THEN 'spell' ELSE 'ic' END AS entity_type, p_name AS entity_name, 'c' || p_partkey % 200 AS chunk_id, 1.0::DOUBLE AS relevance_score FROM part"


def _typed(spark, sf):
    part = load_spread(spark, sf, "part", "p_partkey").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("source"), F.concat(F.lit("c"), (F.col("p_partkey") % 200).cast("string")).alias("chunk_id"), "p_type", "p_size")
    return {kind: part.filter(F.col("p_partkey") % 3 == i) for i, kind in enumerate(("weapon", "spell", "ic"))}


def edges(spark, sf):
    return E.entity_chunk_edges(_typed(spark, sf))


def registry(spark, sf):
    rows = None
    for kind, df in _typed(spark, sf).items():
        part = df.select(F.lit(kind).alias("entity_type"), "name", "source")
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()


@add("entity_chunk_edges", EDGES_SQL)
def _(spark, sf):
    return edges(spark, sf)


NAMES_SQL = """SELECT DISTINCT n AS lookup_name FROM (SELECT string_split(p_name, ' ')[1] AS n FROM part UNION ALL SELECT upper(string_split(p_name, ' ')[2]) FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT substr(p_name, 3, 2) FROM part)"""


def _names(spark, sf):
    part = load_spread(spark, sf, "part", "p_partkey")
    words = F.split("p_name", " ")
    return part.select(F.explode(F.array(F.get(words, F.lit(0)), F.upper(F.get(words, F.lit(1))), F.col("p_name"), F.lower("p_type"), F.substring("p_name", 3, 2))).alias("lookup_name")).distinct()


@add("lookup_entity", f"""WITH r AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'weapon' WHEN 1 THEN 'spell' ELSE 'ic' END AS entity_type, p_name AS name, p_brand AS source FROM part), n AS ({NAMES_SQL}),
 b AS (SELECT lookup_name, arg_min((entity_type, name, source), (CASE entity_type WHEN 'weapon' THEN 0 WHEN 'spell' THEN 1 ELSE 2 END, entity_type <> 'weapon' OR name <> lookup_name, name, source)) AS v FROM n JOIN r ON contains(lower(name), lower(lookup_name)) GROUP BY 1)
 SELECT lookup_name, v[1] AS entity_type, v[2] AS name, v[3] AS source FROM n LEFT JOIN b USING (lookup_name)""")
def _(spark, sf):
    return E.lookup_entity(_names(spark, sf), registry(spark, sf))


@add("related_chunks", f"""WITH e AS ({EDGES_SQL}), w AS (SELECT DISTINCT p_size AS question_id, p_partkey AS entity_ord, CASE p_partkey % 3 WHEN 0 THEN 'weapon' WHEN 1 THEN 'spell' ELSE 'ic' END AS entity_type, string_split(p_name, ' ')[2] AS wanted FROM part)
 SELECT question_id, chunk_id, min(entity_ord) AS entity_ord, 1.0::DOUBLE AS relevance_score FROM w JOIN e ON e.entity_type = w.entity_type AND contains(e.entity_name, w.wanted) GROUP BY 1, 2""")
def _(spark, sf):
    wanted = None
    for kind, df in _typed(spark, sf).items():
        part = df.select(F.col("p_size").alias("question_id"), F.col("p_partkey").alias("entity_ord"), F.lit(kind).alias("entity_type"), F.get(F.split("name", " "), F.lit(1)).alias("wanted"))
        wanted = part if wanted is None else wanted.unionByName(part)
    return E.related_chunks(wanted, edges(spark, sf))


MODES = {"ECONOMY": "SA", "SMALL": "SA/BF", "STANDARD": "FA/BF", "PROMO": "SS"}
MODE_SQL = "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in MODES.items()) + " ELSE 'SEMI / FULL' END"


def weapons(spark, sf):
    mode = F
    for kind, text in MODES.items():
        mode = mode.when(F.col("p_type") == kind, F.lit(text))
    return load_spread(spark, sf, "part", "p_partkey").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("source")).agg(F.min_by("p_type", "p_partkey").alias("p_type")).withColumn("mode", mode.otherwise("SEMI / FULL")).drop("p_type")


WEAPON_REG = f"SELECT name, source, {MODE_SQL} AS mode FROM (SELECT p_name AS name, p_brand AS source, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY 1, 2)"


@add("search_by_mode", f"SELECT name, source, mode FROM ({WEAPON_REG}) WHERE contains(mode, 'BURST') OR contains(mode, 'BF')")
def _(spark, sf):
    return E.search_by_mode(weapons(spark, sf), "burst")


@add("validate_mode", f"""WITH w AS ({WEAPON_REG}), p AS (SELECT DISTINCT lookup_name AS weapon_name, m.mode FROM ({NAMES_SQL}), (VALUES ('burst'), ('Semi-Auto'), ('full auto'), ('ss')) m(mode)),
 f AS (SELECT weapon_name, arg_min((name, mode), (name <> weapon_name, name, source)) AS v FROM (SELECT DISTINCT weapon_name FROM p) JOIN w ON contains(lower(name), lower(weapon_name)) GROUP BY 1),
 j AS (SELECT p.weapon_name, p.mode, v[1] AS name, v[2] AS have, len(list_filter(list_transform(string_split(v[2], '/'), lambda m: trim(m)), lambda m: len(list_filter(CASE p.mode WHEN 'burst' THEN ['BF', 'BURST'] WHEN 'Semi-Auto' THEN ['SA', 'SEMI'] WHEN 'full auto' THEN ['FA', 'FULL'] ELSE ['SS'] END, lambda a: contains(m, a))) > 0)) > 0 AS ok FROM p LEFT JOIN f USING (weapon_name))
 SELECT weapon_name, mode, name, coalesce(ok, false) AS valid, CASE WHEN name IS NULL THEN 'Weapon ''' || weapon_name || ''' not found' WHEN NOT ok THEN name || ' cannot fire in ' || mode || ' mode' END AS error FROM j""")
def _(spark, sf):
    pairs = _names(spark, sf).select(F.col("lookup_name").alias("weapon_name"), F.explode(F.array(*[F.lit(m) for m in ("burst", "Semi-Auto", "full auto", "ss")])).alias("mode"))
    return E.validate_mode(pairs, weapons(spark, sf)).drop("available_modes")


@add("registry_stats", f"""SELECT count(*) FILTER (t = 0) AS weapons, count(*) FILTER (t = 1) AS spells, count(*) FILTER (t = 2) AS ic_programs, (SELECT count(DISTINCT chunk_id) FROM ({EDGES_SQL})) AS chunks_with_entities
 FROM (SELECT DISTINCT p_partkey % 3 AS t, p_name, p_brand FROM part)""")
def _(spark, sf):
    return E.registry_stats(registry(spark, sf), edges(spark, sf))


# ---- entities in questions ---------------------------------------------------------------
Q_PATTERNS = [("weapon", r"\b(?:the|that)\s+\w+", 0.8), ("weapon", r"\w*tion\b", 0.8), ("spell", r"\b(?:der|und|la|le)\b", 0.7), ("ic", r"\b\w+eaux\b", 0.7)]


def _q_sql():
    parts = []
    for i, (kind, pattern, conf) in enumerate(Q_PATTERNS):
        parts.append(f"""SELECT question_id, {i} AS ord, '{kind}' AS entity_type, {conf}::DOUBLE AS confidence, unnest(m) AS hit, generate_subscripts(m, 1) AS k, m, string_split_regex(q, '{pattern}') AS g
 FROM (SELECT question_id, q, regexp_extract_all(q, '{pattern}') AS m FROM (SELECT question_id, lower(question) AS q FROM qq))""")
    return " UNION ALL ".join(parts)


@add("query_entities", f"""WITH qq AS (SELECT question_id, regexp_replace(question, '[^\\x00-\\x7F]', 'x', 'g') AS question FROM ({QUESTIONS_SQL})), h AS ({_q_sql()}),
 n AS (SELECT *, (coalesce(list_sum(list_transform(list_slice(g, 1, k), lambda x: length(x))), 0) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: length(x))), 0))::INT AS position,
 array_to_string(list_filter(string_split_regex(trim(hit), '\\s+'), lambda w: NOT list_contains({sql_list(fv.NOISE_WORDS)}, w)), ' ') AS wanted FROM h),
 f AS (SELECT *, row_number() OVER (PARTITION BY question_id, entity_type, lower(wanted) ORDER BY ord, k) AS r FROM n)
 SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY position, ord, entity_type, wanted) - 1)::INT AS entity_ord, entity_type, wanted, confidence, position FROM f WHERE r = 1""")
def _(spark, sf):
    plain = questions(spark, sf).withColumn("question", F.regexp_replace("question", r"[^\x00-\x7F]", "x"))
    return E.query_entities(plain, patterns=Q_PATTERNS)


ASKED_SQL = f"""SELECT question_id, replace(replace(replace(replace(question, ' the ', ' Burst  Fire '), ' der ', ' semi-automatic '), ' la ', ' full auto '), ' of ', ' single-shot ') AS question FROM ({QUESTIONS_SQL})"""


def _asked(spark, sf):
    q = F.col("question")
    for old, new in ((" the ", " Burst  Fire "), (" der ", " semi-automatic "), (" la ", " full auto "), (" of ", " single-shot ")):
        q = F.replace(q, F.lit(old), F.lit(new))
    return questions(spark, sf).withColumn("question", q)


@add("firing_modes", "SELECT question_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(question), '{p}') THEN '{n}' END" for n, p in fv.FIRING_MODES) + f") AS modes FROM ({ASKED_SQL})")
def _(spark, sf):
    return _asked(spark, sf).select("question_id", F.array_join(SC.firing_modes("question"), ",").alias("modes"))


# names a question holds, by the place of their first mention; its modes; a pair is impossible if the best weapon of that name cannot fire so
COMBO_WORDS = ["ring", "bolt", "widget", "gear", "red", "blue", "hedt", "thor"]
_MODE_ROWS = ", ".join(f"({i}, '{n}', '{p}', {sql_list([n.upper(), *dict(fv.MODE_ALIASES).get(n, [])])}, {sql_list(dict(fv.MODE_ALIASES)[n])})" for i, (n, p) in enumerate(fv.FIRING_MODES))
COMBO_SQL = f"""WITH q AS (SELECT question_id, question, lower(question || ' ring bolt') AS low FROM ({ASKED_SQL})), words(word) AS (VALUES {", ".join(f"('{w}')" for w in COMBO_WORDS)}),
 modes(o, mode, pattern, wanted, aliases) AS (VALUES {_MODE_ROWS}), weapons AS ({WEAPON_REG}),
 named AS (SELECT question_id, word, row_number() OVER (PARTITION BY question_id ORDER BY length(string_split_regex(low, '\\b' || word || '\\b')[1])) - 1 AS entity_ord
 FROM q, words WHERE regexp_matches(low, '\\b' || word || '\\b')),
 fired AS (SELECT question_id, mode, aliases, row_number() OVER (PARTITION BY question_id ORDER BY o) - 1 AS mode_ord FROM q, modes WHERE regexp_matches(low, pattern)),
 best AS (SELECT word, arg_min((name, mode), (name <> word, name, source)) AS w FROM words JOIN weapons ON contains(lower(name), word) GROUP BY 1),
 options AS (SELECT mode, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT m.mode, w.name, row_number() OVER (PARTITION BY m.mode ORDER BY w.name, w.source) AS r
 FROM modes m JOIN weapons w ON len(list_filter(wanted, lambda a: contains(upper(w.mode), a))) > 0) WHERE r <= 3 GROUP BY 1),
 bad AS (SELECT n.question_id, entity_ord, mode_ord, f.mode, CASE WHEN b.w IS NULL THEN 'Weapon ' || chr(39) || n.word || chr(39) || ' not found' ELSE b.w[1] || ' cannot fire in ' || f.mode || ' mode' END AS error
 FROM named n JOIN fired f USING (question_id) LEFT JOIN best b ON n.word = b.word
 WHERE b.w IS NULL OR len(list_filter(string_split(b.w[2], '/'), lambda x: len(list_filter(f.aliases, lambda a: contains(trim(x), a))) > 0)) = 0)
 SELECT question_id, (entity_ord * 100 + mode_ord * 2)::INT AS warning_ord, error AS warning FROM bad UNION ALL
 SELECT question_id, (entity_ord * 100 + mode_ord * 2 + 1)::INT, 'Weapons that support ' || mode || ': ' || names FROM bad JOIN options USING (mode)"""


@add("validate_combinations", COMBO_SQL)
def _(spark, sf):
    patterns = [("weapon", r"\b(?:ring|bolt|widget|gear|red|blue|hedt|thor)\b", 0.8)]
    return E.validate_combinations(_asked(spark, sf).withColumn("question", F.concat("question", F.lit(" ring bolt"))), weapons(spark, sf), patterns=patterns)


# ---- libraries ---------------------------------------------------------------------------
LIB_SQL = f"""SELECT 'lib/' || p_brand || '/' || p_partkey || '.md' AS doc_path, *, CASE WHEN p_partkey % 2 = 0 THEN 'Active' ELSE 'Knowledge' END AS sec FROM (SELECT *, {NAME_TITLE} AS t FROM part)"""


def library_docs(spark, sf):
    part = load_spread(spark, sf, "part", "p_partkey")
    key, size, t = F.col("p_partkey"), F.col("p_size").cast("string"), T.title_case("p_name")
    text = F.concat(
        F.lit("# "), F.when(key % 2 == 0, "Active").otherwise("Knowledge"), F.lit(" Skills\n| Name | Attr | Group |\n|---|---|---|\n| "), t, F.lit(" | Agi | Firearms |\n- "), t,
        F.lit(" Negotiation (Log)\nA long description line of "), size, F.lit(" words.\n* starred line that is long\n## Negative Qualities p. "), size, F.lit("\n| Bad "), t, F.lit(" | "), size,
        F.lit(" | Positive |\n- Worse "), t, F.lit(" ["), size, F.lit("]\nhas rating 1-4 here\n\n# Melee weapons\n| "), t, F.lit(" Knife | 1,2"), size,
        F.lit("¥ | 8R | Armor 3 wireless "), F.lower("p_type"), F.lit(" |\n- "), t, F.lit(" Club (30¥, 2F)\n"))
    rows = part.withColumn("doc_path", F.concat(F.lit("lib/"), "p_brand", F.lit("/"), key.cast("string"), F.lit(".md")))
    return compute_once(rows, "text", text).select("doc_path", "text")


GROUP_CASE = _first_sql("lower(t)", fv.SKILL_GROUPS, "")
SKILLS_SQL = f"""SELECT doc_path, t AS name, CASE sec WHEN 'Active' THEN 'active' ELSE 'knowledge' END AS skill_type, 'agility' AS linked_attribute, 'firearms' AS skill_group, '' AS source_page, '' AS description, 3 AS line_no FROM ({LIB_SQL})
 UNION ALL SELECT doc_path, t || ' Negotiation', CASE sec WHEN 'Active' THEN 'active' ELSE 'knowledge' END, 'logic', {_first_sql("lower(t || ' negotiation')", fv.SKILL_GROUPS, '')}, '', 'A long description line of ' || p_size || ' words.', 4 FROM ({LIB_SQL})"""


@add("extract_skills", SKILLS_SQL)
def _(spark, sf):
    return L.extract_skills(library_docs(spark, sf)).drop("match_no")


# a record that the whole text of a document describes
DESCRIBED_SQL = f"""SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: {sql_strip('l')}) || ['# End'] AS l FROM documents"""
_KEPT = "list_filter({0}, lambda x: NOT starts_with(x, '*') AND length(x) > 10)"
_UNTIL = "list_slice({0}, 1, coalesce(list_position(list_transform({0}, lambda x: regexp_matches(x, '^[#|-]')), true), len({0}) + 1) - 1)"


@add("extract_skills_described", f"""SELECT doc_id, array_to_string({_KEPT.format(_UNTIL.format('l'))}, ' ') AS whole,
 left(array_to_string({_KEPT.format(_UNTIL.format('l[1:3]'))}, ' '), 200) AS short FROM ({DESCRIBED_SQL})""")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.concat(F.lit("- Steady Hand (Log)\n"), "text", F.lit("\n# End")).alias("text"))

    def described(name, **limits):
        return L.extract_skills(docs, "doc_id", **limits).filter("name = 'Steady Hand'").select("doc_id", F.col("description").alias(name))
    return described("whole").join(described("short", description_lines=fv.DESCRIPTION_LINES, description_chars=fv.DESCRIPTION_CHARS), "doc_id")


QUALITIES_SQL = f"""SELECT doc_path, 'Bad ' || t AS name, 'positive' AS quality_type, p_size AS karma_cost, '1-4' AS rating_range, 'p. ' || p_size AS source_page, '' AS description, 8 AS line_no FROM ({LIB_SQL})
 UNION ALL SELECT doc_path, 'Worse ' || t, 'negative', p_size, '1-4', '', 'has rating 1-4 here', 9 FROM ({LIB_SQL})"""


@add("extract_qualities", QUALITIES_SQL)
def _(spark, sf):
    return L.extract_qualities(library_docs(spark, sf)).drop("match_no")


GEAR_LIB_SQL = f"""SELECT doc_path, 'Worse ' || t AS name, 'general' AS category, '' AS subcategory, p_size AS base_cost, '' AS availability, 0 AS armor_value, '' AS rating_range, '' AS source_page, '' AS description, NULL AS properties, 9 AS line_no FROM ({LIB_SQL})
 UNION ALL SELECT doc_path, t || ' Knife', 'weapons', 'melee', ('12' || p_size)::INT, '8R', 3, '', '', 'Armor 3 wireless ' || lower(p_type), '{{"wireless":true}}', 13 FROM ({LIB_SQL})
 UNION ALL SELECT doc_path, t || ' Club', 'weapons', 'melee', 30, '2F', 0, '', '', '', NULL, 14 FROM ({LIB_SQL})"""


@add("extract_gear", GEAR_LIB_SQL)
def _(spark, sf):
    return L.extract_gear(library_docs(spark, sf)).drop("match_no")


def _library_sql(rows, fields):
    picked = ", ".join(f"arg_min({f}, (doc_path, line_no)) AS {f}" for f in fields)
    return f"SELECT name, {picked} FROM ({rows}) GROUP BY 1"


for _kind, _rows, _fields in (("skills", SKILLS_SQL, ["skill_type", "linked_attribute", "skill_group", "description"]), ("qualities", QUALITIES_SQL, ["quality_type", "karma_cost", "source_page"]),
                              ("gear", GEAR_LIB_SQL, ["category", "base_cost", "description"])):
    def _populate(spark, sf, kind=_kind, fields=_fields):
        return L.populate_libraries(library_docs(spark, sf))[kind].select("name", *fields)
    add(f"populate_{_kind}", _library_sql(_rows, _fields))(_populate)


@add("library_lookup", "SELECT p_partkey, p_name AS name, p_name || ' (' || p_size || '¥)' AS label FROM part WHERE p_type = 'ECONOMY'")
def _(spark, sf):
    library = load_spread(spark, sf, "part", "p_partkey").select("p_partkey", F.col("p_name").alias("name"), "p_type", F.col("p_size").alias("base_cost"))
    return L.library_lookup(library, "p_type", "ECONOMY").select("p_partkey", "name", L.choice_label("gear").alias("label"))


@add("skill_names", f"""SELECT p_partkey, {NAME_TITLE} AS name, CASE p_partkey % 3 WHEN 0 THEN 'agility' WHEN 1 THEN 'xyz' ELSE '' END AS attribute, CASE WHEN p_partkey % 4 = 0 THEN 'declared' ELSE {GROUP_CASE.replace('lower(t)', 'lower(p_name)')} END AS skill_group FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    rows = load_spread(spark, sf, "part", "p_partkey").withColumn("name", L.clean_skill_name(F.concat("p_name", F.lit(" (note) [x] *"))))
    return rows.select("p_partkey", "name", SC.map_attribute(F.when(k % 3 == 0, "Agi").when(k % 3 == 1, "XYZ").otherwise("")).alias("attribute"),
                       L.skill_group(F.col("name"), F.when(k % 4 == 0, "Declared").otherwise("None")).alias("skill_group"))
