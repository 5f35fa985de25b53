"""Typed records out of chunk text, and the registry built from them.

Extraction is row-local: regular expressions produce arrays inside the chunk's
row and are exploded once.  The registry operators join by key or through
shared n-grams, never by comparing everything with everything.
"""

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.arrays import at, let
from corpusq.functions.scoring import detect_ic, detect_spell, detect_weapon, firing_modes, found_terms
from corpusq.functions.text import _col, any_term, first_match, lines, quoted, strip, title_case
from corpusq.operators.labelling import spell_category
from corpusq.plans.containment import contains_join
from corpusq.plans.nesting import salted_join
from corpusq.plans.once import compute_once

WEAPON_FIELDS = ["accuracy", "damage", "ap", "mode", "rc", "ammo", "avail", "cost"]


# ---- weapons ----------------------------------------------------------------------
def _cells(line: Column) -> Column:
    inner = F.regexp_replace(strip(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def weapon_rows(text: Column, makers=None, categories=None) -> Column:
    """ARRAY<STRUCT<name, accuracy, ..., cost, category, manufacturer>> of the table rows of a text."""
    makers = fv.WEAPON_MAKERS if makers is None else makers
    categories = fv.WEAPON_CATEGORIES if categories is None else categories
    upper = F.upper(text)
    category = first_match(upper, [(c.title(), [c]) for c in categories], "Unknown")

    def is_row(c):
        name = F.upper(at(c, F.lit(0)))
        return ((F.size(c) >= 8) & (name != "") & ~F.contains(name, F.lit("WEAPON")) & ~F.contains(name, F.lit("FIREARM"))
                & F.rlike(at(c, F.lit(1)), F.lit(f"^(?:{fv.WEAPON_ACCURACY})$"))
                & F.rlike(at(c, F.lit(2)), F.lit(f"^(?:{fv.WEAPON_DAMAGE})$")))

    def row(c, where):
        name = at(c, F.lit(0))
        maker = first_match(F.lower(name), [(m.title(), [m.lower()]) for m in makers], "")
        return F.struct(
            name.alias("name"),
            *[F.coalesce(at(c, F.lit(i + 1)), F.lit("")).alias(f) for i, f in enumerate(WEAPON_FIELDS)],
            where.alias("category"), maker.alias("manufacturer"))

    rows = F.filter(F.transform(F.filter(lines(text), lambda l: F.contains(l, F.lit("|"))), _cells), is_row)
    return let(category, lambda where: F.transform(rows, lambda c: row(c, where)))


def extract_weapon_rows(chunks: DataFrame, key: str = "chunk_id", source: str = "source", text: str = "text",
                        **lists) -> DataFrame:
    return (chunks.select(key, source, F.posexplode(weapon_rows(F.col(text), **lists)).alias("pos", "_w"))
            .select(key, source, "pos", "_w.*"))


def labelled_texts(text: Column) -> Column:
    """ARRAY<STRUCT<label, body>> of ``**Label:** body`` passages."""
    pattern = F.lit("(?dmsU)" + fv.LABELLED_TEXT)
    bodies = F.regexp_extract_all(text, pattern, F.lit(2))
    return let(bodies, lambda b: F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda l, i: F.struct(
        l.alias("label"), strip(at(b, i)).alias("body"))))


def attach_descriptions(records: Column, text: Column) -> Column:
    """Records of a text with description: the first labelled passage whose label contains the name."""
    def described(passages, record):
        hits = F.filter(passages, lambda p: F.contains(F.lower(p["label"]), F.lower(record["name"])))
        return record.withField("description", F.coalesce(F.get(hits, F.lit(0))["body"], F.lit("")))
    return let(labelled_texts(text), lambda passages: F.transform(records, lambda r: described(passages, r)))


# ---- spells and attack programs -------------------------------------------------------
def paragraph_after(name: Column, text: Column) -> Column:
    """First paragraph that follows the name's next blank line."""
    pattern = F.concat(F.lit("(?idsU)"), quoted(name), F.lit("(?-U).*?\n\n([^*]+?)(?=\n\n|\\*\\*|$)"))
    return strip(F.call_function("regexp_extract", text, pattern, F.lit(1)))


def _groups(text: Column, pattern: str, count: int, body) -> Column:
    """Transform all matches; body gets the list of group values."""
    rest = F.struct(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(2, count + 1)])
    return let(rest, lambda r: F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        lambda first, i: body([first] + [at(r[f"g{g}"], i) for g in range(2, count + 1)])))


def _spell(name, kind, range_, damage, duration, drain, description) -> Column:
    return F.struct(name.alias("name"), kind.alias("spell_type"), range_.alias("range"), damage.alias("damage"),
                    duration.alias("duration"), drain.alias("drain"), spell_category(name).alias("category"),
                    description.alias("description"))


def spells_formal(text: Column) -> Column:
    return _groups(text, "(?idU)" + fv.SPELL_RECORD, 6, lambda g: let(title_case(strip(g[0])), lambda name: _spell(
        name, g[1], strip(g[2]), strip(g[3]), strip(g[4]), strip(g[5]), paragraph_after(name, text))))


def _context(text: Column, name: Column, patterns) -> Column:
    """Text from the name to the end of the first format pattern after it."""
    found = [F.nullif(F.call_function("regexp_extract", text, F.concat(F.lit("(?ids)"), quoted(name), F.lit(".*?" + p)),
                                      F.lit(0)), F.lit(""))
             for p in patterns]
    return F.coalesce(*found)


def _field(text: Column, pattern: str) -> Column:
    return F.nullif(strip(F.regexp_extract(text, "(?idU)" + pattern, 1)), F.lit(""))


def _missing(found: Column, formal: Column) -> Column:
    return F.filter(found, lambda f: ~F.exists(formal, lambda s: F.lower(s["name"]) == F.lower(f)))


def spells_contextual(text: Column, found: Column, formal: Column, formats=None) -> Column:
    """Records for detected names without a formal record, read from the text after the name."""
    unknown = F.lit("Unknown")

    def record(name):
        return let(_context(text, name, formats or fv.SPELL_FORMATS), lambda c: let(F.struct(
            _field(c, r"Type:\*\*\s*([MP])").alias("kind"), _field(c, r"Range:\*\*\s*([^;]+)").alias("range"),
            _field(c, r"Duration:\*\*\s*([^;]+)").alias("duration"),
            _field(c, r"Drain:\*\*\s*([^\n]+)").alias("drain")), lambda p: F.when(
                F.coalesce(p["kind"], p["range"], p["duration"], p["drain"]).isNotNull(), _spell(
                    title_case(name), F.coalesce(p["kind"], unknown), F.coalesce(p["range"], unknown), F.lit(""),
                    F.coalesce(p["duration"], unknown), F.coalesce(p["drain"], unknown), F.lit("")))))
    return F.filter(F.transform(_missing(found, formal), record), lambda r: r.isNotNull())


def _ic(name, attack, resist, effect) -> Column:
    return F.struct(name.alias("name"), attack.alias("attack_pattern"), resist.alias("resistance_test"),
                    effect.alias("effect_description"), F.lit("IC").alias("category"))


def ic_formal(text: Column) -> Column:
    return _groups(text, "(?dU)" + fv.IC_RECORD, 3, lambda g: let(strip(g[0]), lambda name: _ic(
        name, strip(g[1]), strip(g[2]), paragraph_after(name, text))))


def ic_contextual(text: Column, found: Column, formal: Column, attacks=None) -> Column:
    unknown = F.lit("Unknown")

    def record(name):
        return let(_context(text, name, attacks or fv.IC_ATTACKS), lambda c: let(F.struct(
            _field(c, r"Attack:\*\*\s*([^v]+?)\s*v\.").alias("attack"), _field(c, r"v\.\s*([^\n]+)").alias("resist")),
            lambda p: F.when(F.coalesce(p["attack"], p["resist"]).isNotNull(), _ic(
                title_case(name), F.coalesce(p["attack"], unknown), F.coalesce(p["resist"], unknown), F.lit("")))))
    return F.filter(F.transform(_missing(found, formal), record), lambda r: r.isNotNull())


def _exploded(chunks, key, source, records) -> DataFrame:
    return (chunks.select(key, source, F.posexplode(records).alias("pos", "_r")).select(key, source, "pos", "_r.*"))


def extract_spells_formal(chunks, key="chunk_id", source="source", text="text") -> DataFrame:
    return _exploded(chunks, key, source, spells_formal(F.col(text)))


def extract_ic_formal(chunks, key="chunk_id", source="source", text="text") -> DataFrame:
    return _exploded(chunks, key, source, ic_formal(F.col(text)))


def spell_records(text: Column, found: Column | None = None) -> Column:
    """Formal records, then contextual ones for all names that occur (``found`` or the fixed list)."""
    names = found_terms(F.lower(text), fv.SPELL_NAMES) if found is None else found
    return let(spells_formal(text), lambda formal: F.concat(formal, spells_contextual(text, names, formal)))


def ic_records(text: Column, found: Column | None = None) -> Column:
    names = detect_ic(text)["found"] if found is None else found
    return let(ic_formal(text), lambda formal: F.concat(formal, ic_contextual(text, names, formal)))


def extract_spells(chunks: DataFrame, key="chunk_id", source="source", text="text", found: str | None = None) -> DataFrame:
    return _exploded(chunks, key, source, spell_records(F.col(text), F.col(found) if found else None))


def extract_ic(chunks: DataFrame, key="chunk_id", source="source", text="text", found: str | None = None) -> DataFrame:
    return _exploded(chunks, key, source, ic_records(F.col(text), F.col(found) if found else None))


TYPES = ("weapon", "spell", "ic")


def entity_records(text: Column, types=TYPES) -> dict[str, Column]:
    """{type: array of records, NULL where the type's detector does not accept the text}; all inside the row."""
    made = {"weapon": (detect_weapon, lambda: attach_descriptions(weapon_rows(text), text)),
            "spell": (detect_spell, lambda: spell_records(text)), "ic": (detect_ic, lambda: ic_records(text))}
    return {kind: F.when(detect(text)["is_content"], records()) for kind, (detect, records) in made.items() if kind in types}


def extract_entities(chunks: DataFrame, key: str = "chunk_id", source: str = "source", text: str = "text",
                     types=TYPES) -> dict[str, DataFrame]:
    """{type: records}; each type only from chunks its detector accepts."""
    return {kind: _exploded(chunks, key, source, records) for kind, records in entity_records(F.col(text), types).items()}


COUNT_NAMES = {"weapon": "weapons", "spell": "spells", "ic": "ic_programs"}


def entity_counts(chunks: DataFrame, text: str = "text", types=TYPES) -> DataFrame:
    """Chunks with the number of records per type and has_entities: one projection, no shuffle."""
    return _counted(chunks, entity_records(F.col(text), types))


def _counted(chunks: DataFrame, records: dict[str, Column]) -> DataFrame:
    names = list(COUNT_NAMES.values())
    sizes = F.struct(*[(F.greatest(F.size(records[k]), F.lit(0)) if k in records else F.lit(0)).cast("bigint").alias(n)
                       for k, n in COUNT_NAMES.items()])
    kept = [c for c in chunks.columns if c not in (*names, "has_entities")]
    total = sum((F.col(f"_sizes.{n}") for n in names), F.lit(0))
    return compute_once(chunks.select(*kept), "_sizes", sizes).select(*kept, "_sizes.*", (total > 0).alias("has_entities"))


# ---- registry -------------------------------------------------------------------------
def registry_upsert(registry: DataFrame, new: DataFrame, seq: str = "seq", keys=("name", "source")) -> DataFrame:
    """Last write per key wins.  max_by combines before the shuffle, so a hot key costs one row per task."""
    both = registry.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return (both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*"))


def entity_chunk_edges(entities: dict[str, DataFrame], key: str = "chunk_id") -> DataFrame:
    edges = None
    for kind, df in entities.items():
        rows = df.select(F.lit(kind).alias("entity_type"), F.col("name").alias("entity_name"), key)
        edges = rows if edges is None else edges.unionByName(rows)
    return edges.distinct().withColumn("relevance_score", F.lit(1.0))


TYPE_ORDER = {"weapon": 0, "spell": 1, "ic": 2}


def lookup_entity(names: DataFrame, registry: DataFrame, name: str = "lookup_name") -> DataFrame:
    """Best registry row per looked-up name: weapon, then spell, then ic; an exact weapon name first.

    ``registry(entity_type, name, source)``; names are distinct.  NULL columns when nothing matches.
    """
    order = F.create_map(*[F.lit(x) for pair in TYPE_ORDER.items() for x in pair])
    # one row per distinct name is enough to find the first source
    entries = registry.groupBy("entity_type", "name").agg(F.min("source").alias("source"))
    pairs = contains_join(entries, "name", names.select(name).distinct(), name)
    inexact = (F.col("entity_type") != "weapon") | (F.col("name") != F.col(name))
    best = pairs.groupBy(name).agg(F.min(F.struct(
        F.try_element_at(order, F.col("entity_type")).alias("o"), inexact.alias("i"), F.col("name"), F.col("source"),
        F.col("entity_type"))).alias("_b"))
    return names.join(best.select(name, "_b.entity_type", "_b.name", "_b.source"), name, "left")


def related_chunks(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks of every entity of a question, first mention first.

    ``entities(question_id, entity_ord, entity_type, wanted)``; edges whose name contains the wanted one.
    Names are matched once per distinct spelling and reach the edges by an equality join.
    """
    asked = entities.groupBy("question_id", "entity_type", "wanted").agg(F.min("entity_ord").alias("entity_ord"))
    spelled = contains_join(edges.select("entity_type", "entity_name").distinct(), "entity_name",
                            asked.select("entity_type", "wanted").distinct(), "wanted", on=["entity_type"])
    by_name = (asked.join(spelled, ["entity_type", "wanted"]).groupBy("question_id", "entity_type", "entity_name")
               .agg(F.min("entity_ord").alias("entity_ord")))
    found = salted_join(edges, by_name, ["entity_type", "entity_name"], "chunk_id", "inner")
    first = found.groupBy("question_id", "chunk_id").agg(F.min(F.struct(
        "entity_ord", (-F.col("relevance_score")).alias("r"))).alias("_f"))
    return first.select("question_id", "chunk_id", "_f.entity_ord", (-F.col("_f.r")).alias("relevance_score"))


def _aliases(mode, table=None) -> Column:
    low = F.lower(_col(mode))
    chain = F
    for name, aliases in table or fv.MODE_ALIASES:
        chain = chain.when(low == name, F.array(*[F.lit(a) for a in aliases]))
    return chain.otherwise(F.array(F.upper(_col(mode))))


def search_by_mode(weapons: DataFrame, mode: str, aliases=None) -> DataFrame:
    """Weapons whose mode holds the requested mode or one of its aliases."""
    known = dict(aliases or fv.MODE_ALIASES)
    wanted = [mode.upper(), *known.get(mode.lower(), [])]
    return weapons.filter(any_term(F.upper("mode"), wanted)).orderBy("name", "source")


def supports_mode(weapon_mode, mode, aliases=None) -> Column:
    modes = F.transform(F.split(_col(weapon_mode), "/"), F.trim)
    return F.exists(modes, lambda m: F.exists(_aliases(mode, aliases), lambda a: F.contains(m, a)))


def validate_mode(pairs: DataFrame, weapons: DataFrame, aliases=None) -> DataFrame:
    """(weapon_name, mode) pairs with valid, error and available_modes."""
    registry = weapons.withColumn("entity_type", F.lit("weapon"))
    found = lookup_entity(pairs.select("weapon_name").distinct(), registry, "weapon_name")
    details = found.join(weapons.select("name", "source", F.col("mode").alias("weapon_mode")), ["name", "source"], "left")
    checked = pairs.join(details.select("weapon_name", "name", "weapon_mode"), "weapon_name", "left")
    valid = F.coalesce(supports_mode("weapon_mode", "mode", aliases), F.lit(False))
    return checked.withColumn("valid", valid).withColumn(
        "error", F.when(F.col("name").isNull(), F.concat(F.lit("Weapon '"), "weapon_name", F.lit("' not found")))
        .when(~F.col("valid"), F.concat("name", F.lit(" cannot fire in "), "mode", F.lit(" mode")))
    ).withColumn("available_modes", F.transform(F.split("weapon_mode", "/"), F.trim)).drop("weapon_mode")


def registry_stats(registry: DataFrame, edges: DataFrame) -> DataFrame:
    counts = registry.agg(*[F.count_if(F.col("entity_type") == k).alias(n)
                            for k, n in (("weapon", "weapons"), ("spell", "spells"), ("ic", "ic_programs"))])
    return counts.withColumn("chunks_with_entities",
                             edges.agg(F.count_distinct("chunk_id")).scalar())


def reextract(chunks: DataFrame, types=TYPES, limit: int | None = None, force: bool = False,
              key: str = "chunk_id", source: str = "source", text: str = "text") -> tuple[dict[str, DataFrame], DataFrame]:
    """Extract again from chunks without entities (all when forced): (records, chunks with new counts)."""
    scope = chunks.orderBy(key).limit(limit) if limit else chunks
    scope = scope if force else scope.filter(~F.coalesce("has_entities", F.lit(False)))
    made = entity_records(F.col(text), types)
    records = {kind: _exploded(scope, key, source, column) for kind, column in made.items()}
    return records, _counted(scope, made).withColumn("entity_extraction_version", F.when(F.col("has_entities"), "2.0"))


def reextract_stats(counted: DataFrame) -> DataFrame:
    total = F.col("weapons") + F.col("spells") + F.col("ic_programs")
    return counted.agg(
        F.count(F.lit(1)).alias("chunks_processed"), F.count_if("has_entities").alias("chunks_with_new_entities"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_found") for c in ("weapons", "spells", "ic_programs")],
        F.coalesce(F.sum(total), F.lit(0)).alias("total_entities_found"))


# ---- entities in questions -----------------------------------------------------------------
def question_entities(question: Column, patterns=None, noise=None) -> Column:
    """ARRAY<STRUCT<position, ord, type, name, confidence>> of pattern matches, first per name, by position."""
    low = F.lower(question)
    noise = fv.NOISE_WORDS if noise is None else noise

    def matches(ord_, kind, pattern, confidence):
        full = F.lit("(?dU)" + pattern)
        pieces = F.split(low, "(?dU)" + pattern, -1)

        def located(hits, gaps):
            def step(acc, x):
                start = acc["at"] + F.length(at(gaps, x["i"]))
                words = F.filter(F.split(strip(x["m"]), r"(?U)\s+"), lambda w: ~w.isin(noise))
                entry = F.struct(start.alias("position"), F.lit(ord_).alias("ord"), F.lit(kind).alias("type"),
                                 F.array_join(words, " ").alias("name"), F.lit(confidence).alias("confidence"))
                return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(entry)).alias("out"))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast(
                "array<struct<position:int,ord:int,type:string,name:string,confidence:double>>").alias("out"))
            return F.aggregate(F.transform(hits, lambda m, i: F.struct(i.alias("i"), m.alias("m"))), zero, step)["out"]
        return let(pieces, lambda gaps: located(F.regexp_extract_all(low, full, F.lit(0)), gaps))

    every = F.concat(*[matches(i, *p) for i, p in enumerate(patterns or fv.QUERY_ENTITY_PATTERNS)])

    def first_of_each(items):
        keys = F.transform(items, lambda e: F.struct(e["type"], F.lower(e["name"])))
        return let(keys, lambda k: F.array_sort(F.filter(items, lambda e, i: F.array_position(k, at(k, i)) == i + 1)))
    return let(every, first_of_each)


def query_entities(questions: DataFrame, question: str = "question", key: str = "question_id", **lists) -> DataFrame:
    found = question_entities(F.col(question), **lists)
    return (questions.select(key, F.posexplode(found).alias("entity_ord", "_e"))
            .select(key, "entity_ord", F.col("_e.type").alias("entity_type"), F.col("_e.name").alias("wanted"),
                    "_e.confidence", "_e.position"))


def validate_combinations(questions: DataFrame, weapons: DataFrame, question: str = "question",
                          key: str = "question_id", aliases=None, patterns=None, suggestions: int = 3) -> DataFrame:
    """(key, warning_ord, warning): impossible weapon and mode pairs of a question, with alternatives."""
    modes = (questions.select(key, F.posexplode(firing_modes(question)).alias("mode_ord", "mode")))
    wanted = query_entities(questions, question, key, patterns=patterns).filter("entity_type = 'weapon'")
    pairs = wanted.join(modes, key).select(key, "entity_ord", "mode_ord", F.col("wanted").alias("weapon_name"), "mode")
    checked = validate_mode(pairs, weapons, aliases)
    known = aliases or fv.MODE_ALIASES
    options = None
    for mode in [m for m, _ in fv.FIRING_MODES]:
        few = search_by_mode(weapons, mode, known).limit(suggestions).agg(
            F.array_sort(F.collect_list("name")).alias("names")).withColumn("mode", F.lit(mode))
        options = few if options is None else options.unionByName(few)
    bad = checked.filter(~F.col("valid")).join(options, "mode", "left")
    texts = F.array(F.col("error"), F.when(F.size("names") > 0, F.concat(
        F.lit("Weapons that support "), "mode", F.lit(": "), F.array_join("names", ", "))))
    return (bad.select(key, "entity_ord", "mode_ord", F.posexplode(F.filter(texts, lambda t: t.isNotNull())).alias("i", "warning"))
            .select(key, (F.col("entity_ord") * 100 + F.col("mode_ord") * 2 + F.col("i")).alias("warning_ord"), "warning"))
