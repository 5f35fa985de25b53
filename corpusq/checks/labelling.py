"""Scores, labels and query analysis.

The word lists below stand for the domain lists: they are made of fragments
that occur in the given texts.
"""

from pyspark.sql import functions as F

from corpusq.checks.fixtures import documents, sql_any, sql_count, sql_text
from corpusq.checks.registry import Checks
from corpusq.functions import fixed_values as fv, scoring as SC, text as T
from corpusq.operators import labelling as L
from corpusq.session import load, load_spread

checks = Checks()
add = checks.add

LEXICON = [("alpha", "erad", 0.25), ("alpha", "tion", 0.1), ("alpha", "qqq", 1.0), ("beta", "ouou", 0.3),
           ("beta", "ó", 0.3), ("beta", "eaux", 0.3), ("gamma", "sch", 0.15), ("gamma", "und ", 0.2), ("gamma", "der", 0.2)]
CAPS = {"beta": 0.5}


def dec(value):
    return f"CAST('{value}' AS DECIMAL(9,3))"


def sql_score(expr, terms):
    return "CAST((" + " + ".join(f"CASE WHEN contains({expr}, '{sql_text(t)}') THEN {dec(w)} ELSE 0 END" for t, w in terms) + ") AS DECIMAL(9,3))"


def sql_patterns(expr, patterns):
    if not patterns:
        return dec(0)
    return "CAST((" + " + ".join(f"CASE WHEN regexp_matches({expr}, '{sql_text(p)}') THEN {dec(w)} ELSE 0 END" for p, w in patterns) + ") AS DECIMAL(9,3))"


def sql_list(terms):
    return "[" + ", ".join(f"'{sql_text(t)}'" for t in terms) + "]"


def sql_found(expr, terms, sep="','"):
    return f"array_to_string(list_filter({sql_list(terms)}, lambda t: contains({expr}, t)), {sep})"


def _lexicon_sql(caps):
    parts = []
    for cat in dict.fromkeys(c for c, _, _ in LEXICON):
        terms = [(t, w) for c, t, w in LEXICON if c == cat]
        score = sql_score("lower(text)", terms)
        if cat in caps:
            score = f"least({score}, {dec(caps[cat])})"
        parts.append(f"SELECT doc_id, '{cat}' AS category, CAST({score} AS DECIMAL(9,3)) AS score, {sql_found('lower(text)', [t for t, _ in terms])} AS found "
                     f"FROM documents WHERE {sql_any('lower(text)', [t for t, _ in terms])}")
    return " UNION ALL ".join(parts)


@add("lexicon_score", _lexicon_sql(CAPS))
def _(spark, sf):
    return L.lexicon_score(documents(spark, sf), LEXICON, "doc_id", caps=CAPS).withColumn("found", F.array_join("found", ","))


NAME_TERMS_SQL = """SELECT p_name AS term, p_brand AS category, min(p_partkey) AS ord, CAST('0.5' AS DECIMAL(9,3)) AS weight FROM part GROUP BY 1, 2"""


@add("lexicon_score_large", f"""SELECT p_partkey, category, sum(weight)::DECIMAL(9,3) AS score, string_agg(term, ',' ORDER BY ord) AS found
 FROM part JOIN ({NAME_TERMS_SQL}) t ON contains(lower(p_type || ' ' || p_name || ' ' || p_brand), lower(term)) GROUP BY 1, 2""")
def _(spark, sf):
    part = load_spread(spark, sf, "part", "p_partkey")
    lexicon = part.groupBy(F.col("p_name").alias("term"), F.col("p_brand").alias("category")).agg(
        F.min("p_partkey").alias("ord")).withColumn("weight", F.lit("0.5").cast("decimal(9,3)"))
    texts = part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("text"))
    scored = L._joined_score(texts, lexicon, "p_partkey", "text", {}, None)
    return scored.withColumn("found", F.array_join("found", ","))


# every word of the benchmark as a term, over whole documents
@add("lexicon_score_texts", """WITH t AS (SELECT word AS term, left(word, 1) AS category, min(item_id) AS ord FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) > 2 GROUP BY 1, 2)
 SELECT doc_id, category, (count(*) * 0.5)::DECIMAL(9,3) AS score, sha256(string_agg(term, ',' ORDER BY term)) AS terms FROM documents JOIN t ON contains(lower(text), term) GROUP BY 1, 2""")
def _(spark, sf):
    words = load(spark, sf, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter("length(term) > 2")
    lexicon = words.groupBy("term", F.left("term", F.lit(1)).alias("category")).agg(F.min("item_id").alias("ord")).withColumn(
        "weight", F.lit("0.5").cast("decimal(9,3)"))
    scored = L._joined_score(load_spread(spark, sf, "documents", "doc_id").select("doc_id", "text"), lexicon, "doc_id", "text", {}, None)
    return scored.select("doc_id", "category", "score", F.sha2(F.array_join(F.array_sort("found"), ","), 256).alias("terms"))


# every long word of the conversations as a term: some thousands at sf0.01
@add("lexicon_score_long_words", """WITH t AS (SELECT DISTINCT word AS term FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM conversations) WHERE length(word) >= 9)
 SELECT doc_id, left(term, 1) AS category, (count(*) * 0.25)::DECIMAL(9,3) AS score, sha256(string_agg(term, ',' ORDER BY term)) AS terms FROM documents JOIN t ON contains(lower(text), term) GROUP BY 1, 2""")
def _(spark, sf):
    words = load(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter("length(term) >= 9").distinct()
    lexicon = words.select("term", F.left("term", F.lit(1)).alias("category"), F.lit("0.25").cast("decimal(9,3)").alias("weight"), F.lit(0).alias("ord"))
    scored = L.lexicon_score(documents(spark, sf).select("doc_id", "text"), lexicon, "doc_id")
    return scored.select("doc_id", "category", "score", F.sha2(F.array_join(F.array_sort("found"), ","), 256).alias("terms"))


PATTERNS = [("number", r"\d+", 0.2), ("number", r"\d{3}", 0.5), ("upper", r"[A-Z]{4}", 0.3)]


@add("regex_score", " UNION ALL ".join(
    f"SELECT * FROM (SELECT doc_id, '{c}' AS category, {sql_patterns('text', [(p, w) for d, p, w in PATTERNS if d == c])} AS score FROM documents) WHERE score > 0"
    for c in ("number", "upper")))
def _(spark, sf):
    return L.regex_score(documents(spark, sf), PATTERNS, "doc_id")


def _detect_sql(total, threshold, scale, found, mark):
    return f"""SELECT doc_id, t >= {threshold} AS is_content, least(t::DOUBLE / {scale}, 1.0) AS confidence, found, m > 0 AS format_seen, t AS total_score
 FROM (SELECT doc_id, CAST({total} AS DECIMAL(9,3)) AS t, {found} AS found, {mark} AS m FROM documents)"""


def _spread(df):
    return df.select("doc_id", "_d.is_content", "_d.confidence", F.array_join("_d.found", ",").alias("found"),
                     "_d.format_seen", "_d.total_score")


SPELLS, MECH, CTX, FORMATS = ["erad", "tionn", "ouou", "sch", "ó", "eaux", "then"], ["the ", "and", "of ", "in ", "re", "an", "er", "it", "is", "on", "ha", "ou"], ["der", "und ", "la ", "le ", "que", "en", "es", "nt", "st", "ed", "ti"], [r"\d{2}", r"[A-Z]{4}"]
FMT_I = [("(?i)" + p, 2.0) for p in FORMATS]


@add("detect_spell", _detect_sql(
    f"{sql_patterns('text', FMT_I)} + {sql_score('lower(text)', [(t, 1.0) for t in SPELLS])} + least({sql_score('lower(text)', [(t, 0.5) for t in MECH])}, 5) + least({sql_score('lower(text)', [(t, 0.3) for t in CTX])}, 3)",
    2.0, 10.0, f"array_to_string(list_slice(list_filter({sql_list(SPELLS)}, lambda t: contains(lower(text), t)), 1, 5), ',')", sql_patterns('text', FMT_I)))
def _(spark, sf):
    return _spread(documents(spark, sf).withColumn("_d", SC.detect_spell("text", SPELLS, FORMATS, MECH, CTX)))


IC_I = [("(?i)" + p, 3.0) for p in FORMATS]


@add("detect_ic", _detect_sql(
    f"{sql_patterns('text', IC_I)} + {sql_score('lower(text)', [(t, 1.5) for t in SPELLS])} + least({sql_score('lower(text)', [(t, 0.5) for t in MECH])}, 4) + least({sql_score('lower(text)', [(t, 0.3) for t in CTX])}, 2)",
    2.0, 10.0, sql_found("lower(text)", SPELLS), sql_patterns('text', IC_I)))
def _(spark, sf):
    return _spread(documents(spark, sf).withColumn("_d", SC.detect_ic("text", SPELLS, FORMATS, MECH, CTX)))


@add("detect_weapon", _detect_sql(
    f"{sql_patterns('text', IC_I)} + {sql_score('lower(text)', [(t, 1.0) for t in SPELLS])} + least({sql_score('lower(text)', [(t, 0.5) for t in CTX])}, 3)",
    1.5, 8.0, f"array_to_string(list_slice(list_filter({sql_list(SPELLS)}, lambda t: contains(lower(text), t)), 1, 5), ',')", sql_patterns('text', IC_I)))
def _(spark, sf):
    return _spread(documents(spark, sf).withColumn("_d", SC.detect_weapon("text", SPELLS, FORMATS, CTX)))


SEC = [("Gear", "makers", "erad", 0.2), ("Gear", "specific_weapons", "tionn", 0.15), ("Gear", "specific_weapons", "thre", 0.25),
       ("Matrix", "ic_programs", "ouou", 0.2), ("Matrix", "matrix_damage", "eaux", 0.2), ("Matrix", "ic_programs", "sch", 0.2),
       ("Magic", "specific_spells", "ó", 0.3), ("Magic", "magic_skills", "der", 0.25)]
SEC_PATTERNS = [("Gear", r"\d+", 0.2), ("Gear", r"[A-Z]{4}", 0.2)]
STATS = ["acc", "and", "of ", "the ", "cost", "re"]


def _section_sql(s):
    return f"CAST({sql_score('lower(text)', [(t, w) for c, _, t, w in SEC if c == s])} + {sql_patterns('text', [(p, w) for c, p, w in SEC_PATTERNS if c == s])} AS DECIMAL(9,3))"


SCORES_SQL = f"SELECT *, {_section_sql('Gear')} AS g, {_section_sql('Matrix')} AS m, {_section_sql('Magic')} AS w FROM documents"
K4_SQL = f"""SELECT doc_id, CASE WHEN greatest(g, m, w) < 0.3 THEN 'Setting' WHEN g >= m AND g >= w THEN 'Gear' WHEN m >= w THEN 'Matrix' ELSE 'Magic' END AS primary_section,
 greatest(g, m, w, {dec(0.3)})::DOUBLE AS confidence, CASE WHEN contains(lower(text), 'dice pool') THEN 'explicit_rule' ELSE 'narrative' END AS content_type,
 contains(lower(text), 'dice pool') OR contains(lower(text), 'test') AS contains_rules, contains(lower(text), 'example') AS contains_examples,
 'pattern_fallback' AS classification_method FROM ({SCORES_SQL})"""
K4_COLS = ["doc_id", "primary_section", "confidence", "content_type", "contains_rules", "contains_examples", "classification_method"]


@add("classify_by_patterns", K4_SQL)
def _(spark, sf):
    return L.classify_by_patterns(documents(spark, sf), lexicon=SEC, patterns=SEC_PATTERNS).select(*K4_COLS)


@add("correct_labels", f"""SELECT doc_id, coalesce(o, CASE quality WHEN 1 THEN 'Rules' ELSE 'Setting' END) AS primary_section,
 CASE WHEN o = 'Gear' AND {sql_count('lower(text)', STATS)} >= 3 THEN 'table' ELSE 'narrative' END AS content_type, g, m, w,
 {sql_found('lower(text)', [t for c, gr, t, _ in SEC if gr in ('specific_weapons', 'ic_programs', 'specific_spells')])} AS items
 FROM (SELECT *, CASE WHEN g > 0.5 THEN 'Gear' WHEN m > 0.4 THEN 'Matrix' WHEN w > 0.4 THEN 'Magic' END AS o FROM ({SCORES_SQL}) JOIN labels USING (doc_id))""")
def _(spark, sf):
    labels = documents(spark, sf).join(load(spark, sf, "labels"), "doc_id").withColumn(
        "primary_section", F.when(F.col("quality") == 1, "Rules").otherwise("Setting")).withColumn("content_type", F.lit("narrative"))
    fixed = L.correct_labels(labels, lexicon=SEC, patterns=SEC_PATTERNS, stats=STATS)
    score = F.col("pattern_scores")
    return fixed.select("doc_id", "primary_section", "content_type", score["Gear"].alias("g"), score["Matrix"].alias("m"),
                        score["Magic"].alias("w"), F.array_join("specific_items_found", ",").alias("items"))


@add("parse_label_responses", f"""SELECT doc_id, CASE WHEN ok THEN 'L' || lang ELSE primary_section END AS primary_section,
 CASE WHEN ok THEN 'table' ELSE content_type END AS content_type, CASE WHEN ok THEN doc_id % 2 = 0 ELSE contains_rules END AS contains_rules,
 CASE WHEN ok THEN 'llm_semantic' ELSE classification_method END AS classification_method
 FROM (SELECT *, doc_id % 3 = 0 AS ok FROM ({K4_SQL})) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
def _(spark, sf):
    doc = F.col("doc_id")
    good = F.concat(F.lit('```json\n{"primary_section": "L'), "lang", F.lit('", "content_type": "table", "contains_rules": '),
                    F.when(doc % 2 == 0, "true").otherwise("false"), F.lit("}\n```"))
    raw = (F.when(doc % 3 == 0, good).when(doc % 3 == 1, F.lit('{"primary_section": "x", "content_type"'))
           .otherwise(F.lit('{"primary_section": "x", "content_type": "y"}')))
    rows = documents(spark, sf).withColumn("raw", raw)
    return L.parse_label_responses(rows, lexicon=SEC, patterns=SEC_PATTERNS).select(
        "doc_id", "primary_section", "content_type", "contains_rules", "classification_method")


def _first_sql(expr, rules, default):
    return "CASE " + " ".join(f"WHEN {sql_any(expr, terms)} THEN '{label}'" for label, terms in rules) + f" ELSE {default} END"


TITLE_RULES = [("Rings", ["ring", "bolt"]), ("Red", ["red", "promo"]), ("Widgets", ["widget", "economy"])]


@add("classify_title", f"SELECT p_partkey, {_first_sql('lower(t)', TITLE_RULES, chr(39) + 'General' + chr(39))} AS section FROM (SELECT *, p_name || ' ' || p_type AS t FROM part)")
def _(spark, sf):
    return load_spread(spark, sf, "part", "p_partkey").select("p_partkey", T.classify_title(F.concat_ws(" ", "p_name", "p_type"), TITLE_RULES).alias("section"))


QUESTIONS_SQL = "SELECT item_id AS question_id, text AS question FROM benchmark UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM conversations WHERE role = 'user'"


def questions(spark, sf):
    bench = load(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    turns = load(spark, sf, "conversations").filter("role = 'user'").select(
        (F.lit(1000000) + F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    return bench.unionByName(turns)


CATS = [("north", ["tion", "erad", "ouou", "then"]), ("south", ["sch", "und", "der", "ich"]), ("east", ["eaux", "que", "ó", "la "]), ("west", ["zzz"])]
EXPANSIONS = {"north": "compass up", "east": "sunrise side"}


def argmax_sql(expr, cats):
    counts = [sql_count(expr, t) if t else "0" for _, t in cats]
    top = f"greatest({', '.join(counts)})"
    return "CASE WHEN " + f"{top} = 0 THEN 'general' " + " ".join(f"WHEN {c} = {top} THEN '{n}'" for (n, _), c in zip(cats, counts)) + " END"


CATEGORY_SQL = f"SELECT question_id, question, {argmax_sql('lower(question)', CATS)} AS category FROM ({QUESTIONS_SQL})"


@add("classify_query", f"SELECT question_id, category FROM ({CATEGORY_SQL})")
def _(spark, sf):
    return L.classify_query(questions(spark, sf), categories=CATS).select("question_id", "category")


@add("expand_query", f"""SELECT question_id, category, question || CASE category WHEN 'north' THEN ' compass up' WHEN 'east' THEN ' sunrise side' ELSE '' END AS expanded
 FROM ({CATEGORY_SQL})""")
def _(spark, sf):
    return L.expand_query(questions(spark, sf), categories=CATS, expansions=EXPANSIONS).select("question_id", "category", "expanded")


INTENTS = [("weapon", ["erad", "tionn", "thre"]), ("matrix", ["ouou", "eaux", "que"]), ("magic", ["ó", "der", "sch", "erad"]), ("social", [])]
TYPES = [("stats_lookup", ["thor", "reti"]), ("comparison", ["ver", "than"]), ("cost_availability", ["ein "])]
ALL_TERMS = sorted({t for _, ts in INTENTS for t in ts})
ENTITIES_SQL = f"list_filter({sql_list(ALL_TERMS)}, lambda t: contains(lower(question), t))"
def analysis_sql(source):
    return f"""SELECT *, least(1.0, (0.5 + least(0.3, len(entities) * 0.1) + CASE WHEN intent <> 'general' THEN 0.2 ELSE 0 END
 + CASE WHEN {sql_any('lower(question)', fv.CLEAR_QUERY_PHRASES)} THEN 0.1 ELSE 0 END)::DECIMAL(6,2)::DOUBLE) AS confidence,
 list_concat(CASE intent WHEN 'weapon' THEN {sql_list(fv.INTENT_BOOSTS['weapon'])} WHEN 'matrix' THEN {sql_list(fv.INTENT_BOOSTS['matrix'])}
 WHEN 'magic' THEN {sql_list(fv.INTENT_BOOSTS['magic'])} ELSE [] END, entities) AS boosts FROM (SELECT question_id, question, {argmax_sql('lower(question)', INTENTS)} AS intent, {ENTITIES_SQL} AS entities,
 CASE {" ".join(f"WHEN {sql_any('lower(question)', ts)} THEN '{n}'" for n, ts in TYPES)} WHEN contains(question, '?') THEN 'question'
 WHEN len(list_filter(string_split_regex(question, '\\s+'), lambda t: t <> '')) <= 3 THEN 'lookup' ELSE 'explanation' END AS query_type,
 {sql_any('lower(question)', fv.TABLE_QUERY_WORDS)} AS wt, {sql_any('lower(question)', fv.RULE_QUERY_WORDS)} AS wr FROM ({source}))"""


ANALYSIS_SQL = analysis_sql(QUESTIONS_SQL)


def analysed(spark, sf):
    return L.analyze_query(questions(spark, sf), intents=INTENTS, query_types=TYPES)


@add("analyze_query", f"""SELECT question_id, intent, array_to_string(entities, ',') AS entities, query_type, CASE intent WHEN 'weapon' THEN 'Gear' WHEN 'matrix' THEN 'Matrix'
 WHEN 'magic' THEN 'Magic' END AS f_section, CASE WHEN wt THEN 'table' END AS f_type, CASE WHEN wr AND NOT wt THEN 'true' END AS f_rules,
 array_to_string(boosts, ',') AS boosts, confidence FROM ({ANALYSIS_SQL})""")
def _(spark, sf):
    f = F.col("filters")
    return analysed(spark, sf).select(
        "question_id", "intent", F.array_join("entities", ",").alias("entities"), "query_type",
        f["primary_section"].alias("f_section"), f["content_type"].alias("f_type"), f["contains_rules"].alias("f_rules"),
        F.array_join("boost_terms", ",").alias("boosts"), "confidence")


SYN = {"erad": "radial", "ouou": "owl", "der": "of it"}


@add("build_enhanced_query", f"""SELECT question_id, array_to_string(list_concat([question], list_filter(boosts, lambda t: NOT contains(lower(question), t)),
 list_filter(list_transform(entities, lambda e: CASE e WHEN 'erad' THEN 'radial' WHEN 'ouou' THEN 'owl' WHEN 'der' THEN 'of it' END), lambda s: s IS NOT NULL)), ' ') AS enhanced_query
 FROM ({ANALYSIS_SQL})""")
def _(spark, sf):
    return L.build_enhanced_query(analysed(spark, sf), synonyms=SYN).select("question_id", "enhanced_query")


@add("role_to_section", """SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Combat' WHEN 'MACHINERY' THEN 'Riggers' WHEN 'FURNITURE' THEN 'Matrix' END AS section FROM customer""")
def _(spark, sf):
    seg = F.col("c_mktsegment")
    role = F.when(seg == "HOUSEHOLD", "Street Samurai").when(seg == "MACHINERY", "rigger").when(seg == "FURNITURE", "Decker").otherwise(seg)
    return load(spark, sf, "customer").select("c_custkey", SC.role_to_section(role).alias("section"))


GEAR_SQL = "SELECT p_partkey, lower(CASE p_partkey % 4 WHEN 0 THEN 'Melee Gun ' WHEN 1 THEN 'Cyberdeck Programs ' WHEN 2 THEN 'Truck drones ' ELSE '' END || p_name) AS h FROM part"


@add("gear_category", f"SELECT p_partkey, {_first_sql('h', fv.GEAR_CATEGORIES, chr(39) + 'general' + chr(39))} AS category, {_first_sql('h', fv.GEAR_SUBCATEGORIES, chr(39) * 2)} AS subcategory FROM ({GEAR_SQL})")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    head = F.concat(F.when(k == 0, "Melee Gun ").when(k == 1, "Cyberdeck Programs ").when(k == 2, "Truck drones ").otherwise(""), "p_name")
    return load_spread(spark, sf, "part", "p_partkey").select("p_partkey", L.gear_category(head).alias("category"), L.gear_subcategory(head).alias("subcategory"))


@add("spell_category", f"SELECT p_partkey, {_first_sql('lower(p_name)', fv.SPELL_CATEGORIES, chr(39) + 'Unknown' + chr(39))} AS category FROM part")
def _(spark, sf):
    return load_spread(spark, sf, "part", "p_partkey").select("p_partkey", L.spell_category("p_name").alias("category"))
