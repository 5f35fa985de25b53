"""Lexicon scoring, section labels, model label parsing and query analysis."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.scoring import (SCORE, _weight, best_label, capped, clear_phrase, found_terms, pattern_score,
                                       term_score)
from corpusq.functions.text import _col, any_term, count_terms, count_tokens, first_match
from corpusq.plans.bounded import TooLarge, small_rows
from corpusq.plans.containment import contains_join

# lexicons up to this many terms are compiled into the expression
INLINE_TERMS = 2000


def lexicon_score(texts: DataFrame, lexicon, key: str, text: str = "text", caps: dict | None = None,
                  limit: int | None = None) -> DataFrame:
    """(key, category, score, found) for every category with a contained term.

    ``lexicon`` is a list of (category, term, weight) or a DataFrame
    (category, term, weight, ord).  A short lexicon becomes literals of one
    projection; one above INLINE_TERMS is joined through shared n-grams.
    """
    if isinstance(lexicon, DataFrame):
        try:
            rows = small_rows(lexicon.select("category", "term", "weight", "ord"), INLINE_TERMS)
            lexicon = [(r["category"], r["term"], r["weight"]) for r in sorted(rows, key=lambda r: r["ord"])]
        except TooLarge:
            return _joined_score(texts, lexicon, key, text, caps or {}, limit)
    low = F.lower(_col(text))
    scored = []
    for category in dict.fromkeys(c for c, _, _ in lexicon):
        terms = [(t, w) for c, t, w in lexicon if c == category]
        score = term_score(low, terms)
        if caps and category in caps:
            score = capped(score, caps[category])
        scored.append(F.struct(F.lit(category).alias("category"), score.cast(SCORE).alias("score"),
                               found_terms(low, [t for t, _ in terms], limit).alias("found")))
    return (texts.select(key, F.explode(F.array(*scored)).alias("_s"))
            .select(key, "_s.*").filter(F.size("found") > 0))


def _joined_score(texts, lexicon, key, text, caps, limit) -> DataFrame:
    hits = contains_join(texts.select(key, F.col(text).alias("_body")), "_body", lexicon, "term").drop("_body")
    scored = hits.groupBy(key, "category").agg(
        F.sum(F.col("weight").cast(SCORE)).cast(SCORE).alias("score"),
        F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("_f"))
    cap = reduce(lambda c, item: c.when(F.col("category") == item[0], F.least("score", _weight(item[1]))),
                 caps.items(), F).otherwise(F.col("score")) if caps else F.col("score")
    found = F.transform("_f", lambda f: f["term"])
    return scored.select(key, "category", cap.cast(SCORE).alias("score"),
                         (F.slice(found, 1, limit) if limit else found).alias("found"))


def regex_score(texts: DataFrame, patterns, key: str, text: str = "text") -> DataFrame:
    """(key, category, score): the weight of each pattern that matches at least once."""
    scored = [F.struct(F.lit(c).alias("category"),
                       pattern_score(text, [(p, w) for d, p, w in patterns if d == c]).alias("score"))
              for c in dict.fromkeys(c for c, _, _ in patterns)]
    return (texts.select(key, F.explode(F.array(*scored)).alias("_s")).select(key, "_s.*").filter("score > 0"))


# ---- section labels --------------------------------------------------------------------
def section_scores(text, lexicon=None, patterns=None, order=None) -> list:
    """[(section, score Column)] in declaration order."""
    col, low = _col(text), F.lower(_col(text))
    lexicon = fv.SECTION_LEXICON if lexicon is None else lexicon
    patterns = fv.SECTION_PATTERNS if patterns is None else patterns
    order = order or fv.SECTION_ORDER
    return [(s, (term_score(low, [(t, w) for c, _, t, w in lexicon if c == s])
                 + pattern_score(col, [(p, w) for c, p, w in patterns if c == s])).cast(SCORE)) for s in order]


def classify_by_patterns(texts: DataFrame, text: str = "text", **lists) -> DataFrame:
    """Label by the best section score; below 0.3 the section is "Setting"."""
    low = F.lower(_col(text))
    pool = F.contains(low, F.lit("dice pool"))
    best = F.col("_best")
    weak = best["score"] < _weight(0.3)
    return (texts.withColumn("_best", best_label(section_scores(text, **lists)))
            .withColumn("primary_section", F.when(weak, "Setting").otherwise(best["label"]))
            .withColumn("confidence", F.when(weak, _weight(0.3)).otherwise(best["score"]).cast("double"))
            .withColumn("content_type", F.when(pool, "explicit_rule").otherwise("narrative"))
            .withColumn("contains_rules", pool | F.contains(low, F.lit("test")))
            .withColumn("is_rule_definition", pool).withColumn("contains_dice_pools", pool)
            .withColumn("contains_examples", F.contains(low, F.lit("example")))
            .withColumn("classification_method", F.lit("pattern_fallback"))
            .withColumn("document_type", F.lit("rulebook")).withColumn("edition", F.lit("SR5"))
            .drop("_best"))


def correct_labels(labels: DataFrame, text: str = "text", lexicon=None, patterns=None, stats=None,
                   limits=None) -> DataFrame:
    """Override primary_section / content_type where the pattern scores are strong; Gear, then Matrix, then Magic."""
    limits = limits or fv.SECTION_OVERRIDE_LIMITS
    lexicon = fv.SECTION_LEXICON if lexicon is None else lexicon
    low = F.lower(_col(text))
    scores = dict(section_scores(text, lexicon, patterns, list(limits)))
    rows = labels.withColumn("pattern_scores", F.create_map(*[x for s, c in scores.items() for x in (F.lit(s), c)]))
    chain = F
    for section, limit in limits.items():
        chain = chain.when(F.col("pattern_scores")[section] > _weight(limit), F.lit(section))
    stat_terms = count_terms(low, stats) if stats else F.lit(0)
    first = next(iter(limits))
    groups = {"Gear": "specific_weapons", "Matrix": "ic_programs", "Magic": "specific_spells"}
    items = [t for s in limits for c, g, t, _ in lexicon if c == s and g == groups.get(s, g)]
    return (rows.withColumn("overridden_by", chain.otherwise(F.lit(None).cast("string")))
            .withColumn("primary_section", F.coalesce("overridden_by", "primary_section"))
            .withColumn("content_type", F.when((F.col("overridden_by") == first) & (stat_terms >= 3), "table")
                        .otherwise(F.col("content_type")))
            .withColumn("specific_items_found", found_terms(low, items) if items else F.array().cast("array<string>")))


LABEL_SCHEMA = "primary_section string, content_type string, contains_rules boolean, confidence double"


def parse_label_responses(responses: DataFrame, raw: str = "raw", text: str = "text", **lists) -> DataFrame:
    """Labels from raw model output; rows without the required fields fall back to the pattern label."""
    bare = F.trim(F.replace(F.replace(F.col(raw), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    parsed = responses.withColumn("_json", F.from_json(bare, LABEL_SCHEMA, {"mode": "PERMISSIVE"}))
    ok = reduce(lambda a, b: a & b, [F.get_json_object(bare, f"$.{f}").isNotNull() for f in fv.LABEL_REQUIRED_FIELDS])
    fallback = classify_by_patterns(parsed.withColumn("_ok", F.coalesce(ok, F.lit(False))), text, **lists)
    pick = {c: F.when(F.col("_ok"), F.col(f"_json.{c}")).otherwise(F.col(c))
            for c in ("primary_section", "content_type", "contains_rules", "confidence")}
    return (fallback.withColumns(pick)
            .withColumn("classification_method", F.when(F.col("_ok"), "llm_semantic")
                        .otherwise(F.col("classification_method")))
            .drop("_json", "_ok"))


# ---- queries ---------------------------------------------------------------------------------
def classify_query(queries: DataFrame, question: str = "question", categories=None) -> DataFrame:
    """Category with most contained terms; the first declared wins a tie, none gives "general"."""
    low = F.lower(_col(question))
    best = best_label([(c, count_terms(low, terms)) for c, terms in (categories or fv.QUERY_CATEGORIES)])
    return queries.withColumn("_b", best).withColumn(
        "category", F.when(F.col("_b.score") > 0, F.col("_b.label")).otherwise("general")).drop("_b")


def expand_query(queries: DataFrame, question: str = "question", categories=None, expansions=None) -> DataFrame:
    expansions = fv.CATEGORY_EXPANSIONS if expansions is None else expansions
    extra = F
    for category, words in expansions.items():
        extra = extra.when(F.col("category") == category, F.concat(F.col(question), F.lit(" " + words)))
    return classify_query(queries, question, categories).withColumn(
        "expanded", extra.otherwise(F.col(question)))


def analyze_query(queries: DataFrame, question: str = "question", intents=None, sections=None, boosts=None,
                  query_types=None) -> DataFrame:
    """intent, entities, query_type, filters, boost_terms and confidence of every question."""
    intents = fv.INTENT_TERMS if intents is None else intents
    sections = fv.INTENT_SECTIONS if sections is None else sections
    boosts = fv.INTENT_BOOSTS if boosts is None else boosts
    low = F.lower(_col(question))
    every = sorted({t for _, terms in intents for t in terms})
    rows = (queries
            .withColumn("_b", best_label([(name, count_terms(low, terms)) for name, terms in intents]))
            .withColumn("intent", F.when(F.col("_b.score") > 0, F.col("_b.label")).otherwise("general"))
            .withColumn("entities", found_terms(low, every)))
    kind = first_match(low, query_types or fv.QUERY_TYPES, F.when(F.contains(low, F.lit("?")), "question")
                       .when(count_tokens(low) <= 3, "lookup").otherwise("explanation"))
    section, own = F, F
    for name, _ in intents:
        section = section.when(F.col("intent") == name, F.lit(sections.get(name)))
        own = own.when(F.col("intent") == name, F.array(*[F.lit(t) for t in boosts.get(name, [])]).cast("array<string>"))
    wants_table, wants_rules = any_term(low, fv.TABLE_QUERY_WORDS), any_term(low, fv.RULE_QUERY_WORDS)
    entries = F.array(
        F.struct(F.lit("primary_section").alias("k"), section.otherwise(F.lit(None).cast("string")).alias("v")),
        F.struct(F.lit("content_type").alias("k"), F.when(wants_table, "table").alias("v")),
        F.struct(F.lit("contains_rules").alias("k"), F.when(~wants_table & wants_rules, "true").alias("v")))
    score = (F.lit("0.5").cast("decimal(4,2)")
             + F.least(F.lit("0.3").cast("decimal(4,2)"), F.size("entities").cast("decimal(4,0)") * F.lit("0.1").cast("decimal(2,1)"))
             + F.when(F.col("intent") != "general", F.lit("0.2").cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)"))
             + F.when(clear_phrase(low), F.lit("0.1").cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)")))
    return (rows.withColumn("query_type", kind)
            .withColumn("filters", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())))
            .withColumn("boost_terms", F.concat(own.otherwise(F.array().cast("array<string>")), F.col("entities")))
            .withColumn("confidence", F.least(F.lit(1.0), score.cast("double")))
            .drop("_b"))


def build_enhanced_query(analysed: DataFrame, question: str = "question", synonyms=None) -> DataFrame:
    """Question, then the boost terms it lacks, then entity synonyms."""
    synonyms = fv.ENTITY_SYNONYMS if synonyms is None else synonyms
    low = F.lower(F.col(question))
    lacking = F.filter("boost_terms", lambda t: ~F.contains(low, t))
    pairs = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    extra = F.filter(F.transform("entities", lambda e: F.try_element_at(pairs, e)), lambda s: s.isNotNull())
    return analysed.withColumn("enhanced_query", F.array_join(
        F.concat(F.array(F.col(question)), lacking, extra), " "))


def gear_category(column) -> Column:
    return first_match(F.lower(_col(column)), fv.GEAR_CATEGORIES, "general")


def gear_subcategory(column) -> Column:
    return first_match(F.lower(_col(column)), fv.GEAR_SUBCATEGORIES, "")


def spell_category(column) -> Column:
    return first_match(F.lower(_col(column)), fv.SPELL_CATEGORIES, "Unknown")
