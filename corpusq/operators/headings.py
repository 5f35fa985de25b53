"""Tables of contents, page ranges, section assembly and header repair."""

from pyspark.sql import DataFrame, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.text import lines, normalise_title, strip
from corpusq.plans.bounded import small_rows
from corpusq.plans.nesting import salted_join
from corpusq.plans.ordered import last_value, neighbours

#: Distinct levels of a table of contents; each is a column of the plan, more raise TooLarge.
MAX_LEVELS = 200
#: Pages that are joined at once; the joined runs of a section are joined again, so this does not show in the result.
PAGES_PER_PART = 20000


def toc_hierarchy(toc: DataFrame, doc: str = "doc") -> DataFrame:
    """Add parent (nearest earlier entry of a smaller level) and the level-1 section.

    One column carries the last entry of each level that occurs, however deep.
    """
    levels = sorted({1, *[r["level"] for r in small_rows(toc.select("level").filter("level is not null").distinct(), MAX_LEVELS)]})
    carried = {f"_l{i}": F.when(F.col("level") == l, F.struct(F.col("seq"), F.col("title"))) for i, l in enumerate(levels)}
    rows = last_value(toc, [doc], "seq", carried)
    above = F.array_max(F.array(*[F.when(F.col("level") > l, F.col(f"_l{i}")) for i, l in enumerate(levels)]))
    return rows.select(*toc.columns, above["title"].alias("parent"), F.col(f"_l{levels.index(1)}.title").alias("section"))


def toc_page_ranges(toc: DataFrame, page_count: DataFrame, doc: str = "doc") -> DataFrame:
    """start_page = page, end_page = next entry's page - 1, the last runs to the document's end.

    ``page_count(doc, page_count)`` has one row per document.
    """
    ranges = neighbours(toc, [doc], "seq", ["page"])
    return (salted_join(ranges, page_count, [doc], "seq", counted=toc)
            .select(*toc.columns, F.col("page").alias("start_page"),
                    F.coalesce(F.col("next_page"), F.col("page_count")).alias("_stop"), "page_count")
            .withColumn("end_page", F.least(F.col("_stop"), F.col("page_count")) - 1)
            .drop("_stop", "page_count"))


def assemble_section_text(pages: DataFrame, ranges: DataFrame, doc: str = "doc",
                          pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Join the non-blank pages of each range with a blank line, in page order.

    The range join is an equality join: each range lists its page numbers.
    One row per section of any length; part is always 0.  Runs of
    ``pages_per_part`` pages are joined first and then their texts, in order.
    """
    wanted = (ranges.filter("end_page >= start_page")
              .withColumn("page_no", F.explode(F.sequence(F.col("start_page"), F.col("end_page"))))
              .withColumn("_run", F.floor((F.col("page_no") - F.col("start_page")) / F.lit(pages_per_part)))
              .select(doc, "seq", "title", "_run", "page_no"))
    texts = pages.filter(strip("text") != "").select(doc, F.col("page").alias("page_no"), "text")

    def joined(rows, group, order):
        return (rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("_t"))
                .select(*group, F.array_join(F.col("_t")["text"], "\n\n").alias("text")))
    section = [doc, "seq", "title"]
    runs = joined(texts.join(wanted, [doc, "page_no"]), [*section, "_run"], "page_no")
    return joined(runs, section, "_run").select(*section, F.lit(0).cast("long").alias("part"), "text")


def extract_headers(docs: DataFrame, key: str = "doc_path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, line_no, level, title, _line) of every markdown header line."""
    found = docs.select(key, *keep, F.posexplode(lines(text)).alias("line_no", "_raw")).withColumn("_line", strip("_raw"))
    pattern = r"(?dU)^(#{1,6})\s*(.+?)$"
    return (found.filter(F.rlike("_line", F.lit(pattern)))
            .select(key, *keep, "line_no", F.length(F.regexp_extract("_line", pattern, 1)).alias("level"),
                    strip(F.regexp_extract("_line", pattern, 2)).alias("title"), "_line"))


def title_levels(toc: DataFrame, hints: list[tuple[str, str]], source: str = "source") -> DataFrame:
    """(source, norm, any_level, in_hint): one row per spelling of a title.

    A title is known as written, which gives ``any_level`` (the last one counts),
    and as normalised.  ``in_hint`` has one entry per hint: null if no top section
    of the source contains the hinted name, else the level the title has in the
    first such section (null inside if it does not occur there).
    """
    placed = toc_hierarchy(toc, source)
    owners = (placed.filter(F.col("section").isNotNull()).groupBy(source).agg(*[
        F.min_by("section", F.when(F.contains(F.lower("section"), F.lit(name.lower())), F.col("seq"))).alias(f"_owner{i}")
        for i, (_, name) in enumerate(hints)] or [F.lit(None).alias("_none")]))
    spellings = F.array(F.struct(F.col("title").alias("norm"), F.col("level").alias("exact"), F.lit(None).cast("int").alias("inner")),
                        F.struct(normalise_title("title").alias("norm"), F.lit(None).cast("int").alias("exact"), F.col("level").alias("inner")))
    rows = (salted_join(placed, owners, [source], "seq", counted=toc)
            .select(source, "seq", "section", *[f"_owner{i}" for i in range(len(hints))], F.explode(spellings).alias("_s"))
            .select("*", "_s.*"))

    def inside(i):
        level = F.min_by("inner", F.when((F.col("section") == F.col(f"_owner{i}")) & F.col("inner").isNotNull(), F.col("seq")))
        return F.when(F.first(f"_owner{i}", ignorenulls=True).isNotNull(), F.struct(level.alias("level")))
    return rows.groupBy(source, "norm").agg(
        F.max_by("exact", F.when(F.col("exact").isNotNull(), F.col("seq"))).alias("any_level"),
        F.array(*[inside(i) for i in range(len(hints))]).alias("in_hint"))


def fix_headers(docs: DataFrame, toc: DataFrame, key: str = "doc_path", source: str = "source",
                hints: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rewrite header lines by the table of contents of the document's source.

    Known titles get their level and normalised spelling, unknown ones lose the
    markup, known ones without a level stay.  ``hints`` are (piece of a file
    name, name of a section), in order; the first whose piece the file name
    holds and whose name a top section of the source contains decides the section in which a
    level is looked up first.  Only header lines are joined; texts meet their
    changed lines by key.
    """
    hints = fv.FILE_SECTION_HINTS if hints is None else hints
    headers = extract_headers(docs, key, keep=(source,)).withColumn("norm", normalise_title("title"))
    known = title_levels(toc, hints, source).withColumn("known", F.lit(True))
    file_name = F.lower(F.substring_index(F.col(key), "/", -1))
    inside = F
    for i, (piece, _) in enumerate(hints):
        entry = F.get("in_hint", F.lit(i))
        inside = inside.when(F.contains(file_name, F.lit(piece)) & entry.isNotNull(), entry["level"])
    inside = inside.otherwise(F.lit(None).cast("int")) if hints else F.lit(None).cast("int")
    fixed = F.concat(F.expr("repeat('#', _level)"), F.lit(" "), F.col("norm"))
    # not salted: counting the titles would parse every text once more; the adaptive skew join splits a title of very many headers
    changes = (headers.join(known.hint("merge"), [source, "norm"], "left")
               .withColumn("_level", F.coalesce(inside, "any_level"))
               .withColumn("new_line", F.when(F.col("known").isNull(), F.col("title"))
                           .when(F.col("_level").isNotNull() & (F.col("_line") != fixed), fixed))
               .filter(F.col("new_line").isNotNull())
               .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("line_no", "new_line"))).alias("_new")))
    return (docs.join(changes, key, "left")
            .withColumn("text", F.when(F.col("_new").isNull(), F.col("text")).otherwise(F.array_join(F.transform(
                lines("text"), lambda l, i: F.coalesce(F.try_element_at(F.col("_new"), i), l)), "\n")))
            .select(*docs.columns))
