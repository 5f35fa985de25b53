"""Reference libraries (skills, qualities, gear) from rulebook text.

A document's lines are annotated inside its row with their section header and
neighbours, matched, and exploded once; duplicates collapse by a combining
aggregate, so one name in every document is still cheap.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.arrays import at, fold, ints, let
from corpusq.functions.scoring import map_attribute
from corpusq.functions.text import any_term, first_match, lines, strip, title_case
from corpusq.operators.labelling import gear_category, gear_subcategory


# ---- annotated lines -----------------------------------------------------------------
def _sectioned_lines(text: Column) -> Column:
    """ARRAY<STRUCT<raw, section>>: each line with the last header line up to it, lower-cased."""
    parts = F.split(text, r"(?dm)(?=^[^\S\n]*#)")

    def of_part(part, last):
        body = F.when(last, part).otherwise(F.regexp_replace(part, r"\n\z", ""))
        first = strip(F.substring_index(part, "\n", 1))
        section = F.when(F.startswith(first, F.lit("#")), F.lower(first)).otherwise("")
        return let(section, lambda s: F.transform(lines(body), lambda l: F.struct(l.alias("raw"), s.alias("section"))))
    return let(parts, lambda ps: F.flatten(F.transform(ps, lambda p, i: of_part(p, i == F.size(ps) - 1))))


def _page(here, before, after) -> Column:
    found = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for line in (here, before, after) for p in fv.PAGE_MENTIONS]
    page = F.coalesce(*found)
    return F.when(page.isNotNull(), F.concat(F.lit("p. "), page)).otherwise("")


def _description(following: Column, chars: int | None) -> Column:
    """Text of the following lines, until a header, table or list line."""
    stripped = F.transform(following, strip)

    def cut(rows):
        stop = F.array_position(F.transform(rows, lambda l: F.rlike(l, F.lit(r"^[#|\-]"))), True)
        head = F.when(stop > 0, F.slice(rows, F.lit(1), stop.cast("int") - 1)).otherwise(rows)
        kept = F.filter(head, lambda l: ~F.startswith(l, F.lit("*")) & (F.length(l) > 10))
        whole = F.array_join(kept, " ")
        return F.left(whole, F.lit(chars)) if chars else whole
    return let(stripped, cut)


def _rating(nearby: Column) -> Column:
    found = F.filter(F.transform(nearby, lambda l: F.regexp_extract(F.lower(l), fv.QUALITY_RATING, 1)), lambda r: r != "")
    return F.coalesce(at(found, F.lit(0)), F.lit(""))


def _matches(line: Column, patterns, groups: int) -> Column:
    """ARRAY<STRUCT<pattern, g1..gN>> of all matches, in pattern then match order."""
    def of(index, pattern):
        n = _group_count(pattern)
        full = F.lit("(?d)" + pattern)
        rest = F.struct(*[(F.regexp_extract_all(line, full, F.lit(g)) if g <= n else F.array().cast("array<string>")).alias(f"g{g}")
                          for g in range(2, groups + 1)])
        return let(rest, lambda r: F.transform(F.regexp_extract_all(line, full, F.lit(1)), lambda x, i: F.struct(
            F.lit(index).alias("pattern"), strip(x).alias("g1"),
            *[strip(F.coalesce(at(r[f"g{g}"], i), F.lit(""))).alias(f"g{g}") for g in range(2, groups + 1)])))
    return F.concat(*[of(i, p) for i, p in enumerate(patterns)])


def _group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def _candidates(docs: DataFrame, path: str, text: str, patterns, extra: dict, whole: bool = False) -> DataFrame:
    """(path, line_no, line, section, + extra(rows, i, stops)) of the lines that match a record pattern.

    Lines are chosen first; pages and descriptions are read only for those.
    With ``whole``, stops[i] is the next line after i that ends a description.
    """
    def holds_record(line):
        likely = F.contains(line, F.lit("|")) | F.rlike(line, F.lit(r"^[-*#]"))
        return likely & reduce(lambda a, b: a | b, [F.rlike(line, F.lit("(?d)" + p)) for p in patterns])

    def annotate(rows):
        return let(_next_stops(rows), lambda stops: chosen_of(rows, stops)) if whole else chosen_of(rows, None)

    def chosen_of(rows, stops):
        named = F.transform(rows, lambda r, i: F.struct(i.alias("line_no"), strip(r["raw"]).alias("line"), r["section"].alias("section")))
        chosen = F.filter(named, lambda r: holds_record(r["line"]))
        return F.transform(chosen, lambda r: F.struct(
            r["line_no"].alias("line_no"), r["line"].alias("line"), r["section"].alias("section"),
            *[make(rows, r["line_no"], stops).alias(name) for name, make in extra.items()]))
    return docs.select(path, F.explode(let(_sectioned_lines(F.col(text)), annotate)).alias("_l")).select(path, "_l.*")


def _raw(rows, i):
    return F.coalesce(F.get(rows, i)["raw"], F.lit(""))


def _following(rows, i, n, first=1):
    return F.transform(F.slice(rows, i + 1 + first, F.lit(n)), lambda r: r["raw"])


def _next_stops(rows: Column) -> Column:
    """ARRAY<INT>: for each line the next header, table or list line after it, else the number of lines; one run from the end."""
    marks = F.transform(F.reverse(rows), lambda r: F.rlike(strip(r["raw"]), F.lit(r"^[#|\-]")))
    numbered = F.transform(marks, lambda m, n: F.struct(m.alias("stop"), n.alias("n")))
    none = ints()

    def from_end(found):
        def step(acc, x):
            return F.struct(F.when(x["stop"], F.size(rows) - 1 - x["n"]).otherwise(acc["next"]).alias("next"),
                            F.concat(acc["out"], F.array(acc["next"])).alias("out"))
        return F.reverse(fold(found, F.struct(F.size(rows).alias("next")), ["next"], none, step, lambda acc: acc["out"]))
    return let(numbered, from_end)


_PAGE = {"source_page": lambda rows, i, _: _page(strip(_raw(rows, i)), F.when(i > 0, _raw(rows, i - 1)).otherwise(""), _raw(rows, i + 1))}


def _text(lines: int | None, chars: int | None) -> dict:
    """The description of a record: at most so many lines and characters, all up to the next header, table or list line for None."""
    if lines is None:
        return {"description": lambda rows, i, stops: _description(F.transform(
            F.slice(rows, i + 2, F.greatest(at(stops, i) - i - 1, F.lit(0))), lambda r: r["raw"]), chars)}
    return {"description": lambda rows, i, _: _description(_following(rows, i, lines), chars)}


def _first_per_name(rows: DataFrame, path: str, fields: list[str]) -> DataFrame:
    order = F.struct("line_no", "match_no")
    return (rows.groupBy(path, "name").agg(F.min_by(F.struct("line_no", "match_no", *fields), order).alias("_f"))
            .select(path, "name", "_f.*"))


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\s*\(.*?\)\s*", ""), r"\s*\[.*?\]\s*", "")


# ---- skills ---------------------------------------------------------------------------
def clean_skill_name(name: Column) -> Column:
    return title_case(strip(F.replace(_bare(name), F.lit("*"), F.lit(""))))


def skill_group(name: Column, declared: Column, groups=None) -> Column:
    low = F.lower(declared)
    detected = first_match(F.lower(name), groups or fv.SKILL_GROUPS, "")
    return F.when((low != "") & (low != "none"), low).otherwise(detected)


def extract_skills(docs: DataFrame, path: str = "doc_path", text: str = "text", description_lines: int | None = None,
                   description_chars: int | None = None) -> DataFrame:
    """Skill rows.  A description is whole unless its lines or characters are limited (``fv.DESCRIPTION_LINES``, ``_CHARS``)."""
    lines_ = _candidates(docs, path, text, fv.SKILL_PATTERNS, {**_PAGE, **_text(description_lines, description_chars)},
                         description_lines is None)
    rows = (lines_.select("*", F.posexplode(_matches(F.col("line"), fv.SKILL_PATTERNS, 3)).alias("match_no", "_m"))
            .withColumn("name", clean_skill_name(F.col("_m.g1")))
            .filter((F.length("name") >= 3) & ~F.lower("name").isin(fv.SKILL_STOP_NAMES)))
    kind = (F.when(any_term("section", fv.KNOWLEDGE_SECTION_WORDS), "knowledge")
            .when(any_term("section", fv.LANGUAGE_SECTION_WORDS), "language").otherwise("active"))
    rows = (rows.withColumn("skill_type", kind)
            .withColumn("linked_attribute", map_attribute(F.col("_m.g2")))
            .withColumn("skill_group", skill_group(F.col("name"), F.col("_m.g3"))))
    return _first_per_name(rows, path, ["skill_type", "linked_attribute", "skill_group", "source_page", "description"])


# ---- qualities -------------------------------------------------------------------------
def extract_qualities(docs: DataFrame, path: str = "doc_path", text: str = "text", description_lines: int | None = None,
                      description_chars: int | None = None) -> DataFrame:
    """Quality rows; a type cell also applies to the later matches of its line.  Descriptions as in ``extract_skills``."""
    lines_ = _candidates(docs, path, text, fv.QUALITY_PATTERNS, {
        **_PAGE, **_text(description_lines, description_chars), "rating_range": lambda rows, i, _: _rating(_following(rows, i, 3, 0))}, description_lines is None)

    def named(m):
        name = strip(_bare(m["g1"]))
        return F.struct(name.alias("name"), m["g2"].alias("cost"),
                        ((F.length(name) >= 3) & ~F.lower(name).isin(fv.QUALITY_STOP_NAMES)).alias("valid"),
                        F.when(F.startswith(F.lower(m["g3"]), F.lit("neg")), "negative")
                        .when(F.startswith(F.lower(m["g3"]), F.lit("pos")), "positive").alias("stated"))

    def settled(ms):
        return F.transform(ms, lambda m, i: F.struct(
            m["name"].alias("name"), m["cost"].alias("cost"), m["valid"].alias("valid"),
            F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(
                F.slice(ms, F.lit(1), i + 1), lambda v: v["valid"] & v["stated"].isNotNull()), lambda v: v["stated"])),
                -1).alias("stated")))

    found = let(F.transform(_matches(F.col("line"), fv.QUALITY_PATTERNS, 3), named), settled)
    by_section = F.when(any_term("section", fv.NEGATIVE_SECTION_WORDS), "negative").otherwise("positive")
    cost = F.regexp_extract("_m.cost", r"[0-9]+", 0)
    rows = (lines_.select("*", F.posexplode(found).alias("match_no", "_m")).filter("_m.valid")
            .withColumn("name", F.col("_m.name"))
            .withColumn("quality_type", F.coalesce("_m.stated", by_section))
            .withColumn("karma_cost", F.when(cost == "", 0).otherwise(cost.try_cast("int"))))
    return _first_per_name(rows, path, ["quality_type", "karma_cost", "rating_range", "source_page", "description"])


# ---- gear --------------------------------------------------------------------------------
def _first_number(text: Column, patterns) -> Column:
    return F.coalesce(*[F.regexp_extract(text, p, 1).try_cast("int") for p in patterns], F.lit(0))


def _first_text(text: Column, patterns) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit(""))


def extract_gear(docs: DataFrame, path: str = "doc_path", text: str = "text") -> DataFrame:
    lines_ = _candidates(docs, path, text, fv.GEAR_PATTERNS, _PAGE)
    rows = lines_.select("*", F.posexplode(_matches(F.col("line"), fv.GEAR_PATTERNS, 4)).alias("match_no", "_m"))
    rows = (rows.withColumn("name", strip(F.regexp_replace(F.col("_m.g1"), r"\s*\(Rating [0-9\-]+\)\s*", "")))
            .filter((F.length("name") >= 3) & ~F.lower("name").isin(fv.GEAR_STOP_NAMES)))
    both = F.lower(F.concat_ws(" ", F.col("name"), F.col("_m.g4")))
    cost = F.regexp_extract(F.regexp_replace("_m.g2", "[¥,]", ""), "[0-9]+", 0)
    notes = F.lower("_m.g4")
    flags = F.map_filter(F.create_map(
        F.lit("wireless"), F.contains(notes, F.lit("wireless")),
        F.lit("smartlink"), F.contains(notes, F.lit("smartlink"))), lambda _, v: v)
    sectioned = F.col("section") != ""
    rows = (rows.withColumn("category", F.when(sectioned, gear_category("section")).otherwise(""))
            .withColumn("subcategory", F.when(sectioned, gear_subcategory("section")).otherwise(""))
            .withColumn("base_cost", F.when(cost == "", 0).otherwise(cost.try_cast("int")))
            .withColumn("availability", F.col("_m.g3"))
            .withColumn("armor_value", _first_number(both, fv.ARMOR_VALUES))
            .withColumn("rating_range", _first_text(both, fv.RATING_RANGES))
            .withColumn("description", F.col("_m.g4"))
            .withColumn("properties", F.when(F.size(flags) > 0, F.to_json(flags))))
    return _first_per_name(rows, path, ["category", "subcategory", "base_cost", "availability", "armor_value",
                                        "rating_range", "source_page", "description", "properties"])


# ---- libraries -----------------------------------------------------------------------------
def first_by_name(records: DataFrame, path: str = "doc_path") -> DataFrame:
    """Insert-or-ignore on name: the first document, then the first line, wins."""
    rest = [c for c in records.columns if c != "name"]
    order = F.struct(path, "line_no", "match_no")
    return (records.groupBy("name").agg(F.min_by(F.struct(*rest), order).alias("_f")).select("name", "_f.*")
            .drop("line_no", "match_no"))


def populate_libraries(docs: DataFrame, path: str = "doc_path", text: str = "text") -> dict[str, DataFrame]:
    return {"skills": first_by_name(extract_skills(docs, path, text), path),
            "qualities": first_by_name(extract_qualities(docs, path, text), path),
            "gear": first_by_name(extract_gear(docs, path, text), path)}


def save_libraries(libraries: dict[str, DataFrame], root: str) -> None:
    for name, df in libraries.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def library_lookup(library: DataFrame, column: str, value=None) -> DataFrame:
    """Rows of one type, by name; without a value all rows by type and name."""
    if value is None:
        return library.orderBy(column, "name")
    return library.filter(F.col(column) == value).orderBy("name")


def choice_label(kind: str) -> Column:
    """Name with the attribute, karma cost or price in brackets."""
    name = F.col("name")
    if kind == "skills":
        extra = F.when(F.coalesce(F.col("linked_attribute"), F.lit("")) != "", F.concat(
            F.lit(" ("), "linked_attribute", F.lit(")")))
    elif kind == "qualities":
        extra = F.when(F.col("karma_cost") != 0, F.concat(F.lit(" ("), F.col("karma_cost").cast("string"), F.lit(" karma)")))
    else:
        extra = F.when(F.col("base_cost") > 0, F.concat(F.lit(" ("), F.col("base_cost").cast("string"), F.lit("¥)")))
    return F.concat(name, F.coalesce(extra, F.lit("")))
