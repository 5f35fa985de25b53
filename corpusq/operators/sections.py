"""Sections, tables and content blocks of a document.

A document is one row, so everything here is row-local: the text is split by
built-in expressions and folded in place.  No shuffle, and a long document or a
source that owns most documents cannot create a hot task.
"""

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.arrays import at, fold, let
from corpusq.functions.quality import header_level, occurrences
from corpusq.functions.text import any_term, lines, strip, strip_left

HEADER_LINE = r"#{1,3}[^\S\n]+\S"
_INDENT = r"[^\S\n]*"


def header_sections(text: Column, header: str = HEADER_LINE) -> Column:
    """ARRAY<STRUCT<title, level, content>> split before each header line.

    The header line is not content; sections with blank content are dropped; a
    text that has none left becomes one section titled "Content".
    """
    opening = f"(?U)^{_INDENT}{header}"
    parts = F.split(F.concat(text, F.lit("\n")), f"(?dmU)(?=^{_INDENT}{header})")
    if header == HEADER_LINE:
        parts = F.when(F.contains(text, F.lit("#")), parts).otherwise(F.array(F.concat(text, F.lit("\n"))))

    def section(part):
        def of_line(line):
            return let(F.rlike(line, F.lit(opening)), lambda head: of_head(line, head))

        def of_head(line, head):
            first = strip(line)
            return F.struct(
                F.when(head, strip(F.regexp_replace(first, r"^#+", ""))).otherwise("").alias("title"),
                F.when(head, F.length(F.regexp_extract(first, r"^(#*)", 1))).otherwise(1).alias("level"),
                F.when(head, F.substr(part, F.instr(part, "\n") + F.lit(1))).otherwise(part).alias("content"))
        return let(F.substring_index(part, "\n", 1), of_line)

    kept = F.filter(F.transform(parts, section), lambda s: strip_left(s["content"]) != "")
    whole = F.array(F.struct(F.lit("Content").alias("title"), F.lit(1).alias("level"), text.alias("content")))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).when(strip_left(text) != "", whole).otherwise(k))


def split_by_headers(docs: DataFrame, text: str = "text", header: str = HEADER_LINE) -> DataFrame:
    """One row per section; replaces the text column by section_index, title, level, content."""
    keep = [c for c in docs.columns if c != text]
    return (docs.select(*keep, F.posexplode(header_sections(F.col(text), header)).alias("section_index", "_s"))
            .select(*keep, "section_index", F.col("_s.title").alias("section_title"),
                    F.col("_s.level").alias("section_level"), F.col("_s.content").alias("content")))


def semantic_sections(text: Column, boundaries=None) -> Column:
    """ARRAY<STRUCT<title, level, content, start_pos, line_start, line_end>>.

    Boundary lines stay in the content.  A boundary on the first line opens nothing.
    """
    rules = "|".join(f"(?:{p})" for p in (boundaries or fv.SEMANTIC_BOUNDARIES))
    # a boundary is a whole stripped line, so blanks may surround it; never the first line of the text
    cut = rf"(?dm)(?<=\n)(?={_INDENT}(?:{rules}){_INDENT}$)"
    parts = F.split(text, cut)

    def step(acc, part):
        n = F.size(lines(part)) - F.when(F.endswith(part, F.lit("\n")), 1).otherwise(0)
        first = acc["n"] == 0
        title = strip(F.substring_index(part, "\n", 1))
        section = F.struct(
            F.when(first, "Content").otherwise(title).alias("title"),
            F.when(first, 1).otherwise(header_level(title)).alias("level"),
            strip(part).alias("content"),
            F.when(first, 0).otherwise(acc["chars"] - 1).alias("start_pos"),
            acc["line"].alias("line_start"),
            (acc["line"] + n - 1).alias("line_end"))
        return F.struct(
            (acc["n"] + 1).alias("n"), (acc["line"] + n).alias("line"),
            (acc["chars"] + F.length(part)).alias("chars"),
            F.concat(acc["out"], F.array(section)).alias("out"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("line"), F.lit(0).alias("chars"))
    none = F.array().cast("array<struct<title:string,level:int,content:string,start_pos:int,line_start:int,line_end:int>>")
    return F.filter(fold(parts, zero, ["n", "line", "chars"], none, step)["out"], lambda s: s["content"] != "")


def split_semantic(docs: DataFrame, text: str = "text", boundaries=None) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    return (docs.select(*keep, F.posexplode(semantic_sections(F.col(text), boundaries)).alias("section_index", "_s"))
            .select(*keep, "section_index", F.col("_s.title").alias("section_title"),
                    F.col("_s.level").alias("section_level"), F.col("_s.content").alias("content"),
                    F.col("_s.start_pos").alias("start_pos"), F.col("_s.line_start").alias("line_start"),
                    F.col("_s.line_end").alias("line_end")))


# ---- tables ---------------------------------------------------------------------------
TABLE_TYPE = "array<struct<start_line:int,end_line:int,table_type:string>>"


def table_ranges(text: Column, stat_words=None) -> Column:
    """ARRAY<STRUCT<start_line, end_line, table_type>> of markdown tables and stat blocks."""
    words = stat_words or fv.DETECT_STAT_WORDS

    def classify(rows):
        def one(line, i):
            two = occurrences(line, "|") >= 2
            ruled = F.coalesce(F.rlike(at(rows, i + 1), F.lit(r"(?U)^[\s|:\-]+$")), F.lit(False))
            return F.struct(
                i.alias("i"),
                (two & ruled).alias("opens_table"),
                (~two & any_term(F.lower(line), words)).alias("opens_stats"),
                F.contains(line, F.lit("|")).alias("piped"),
                ((line == "") | ~(F.startswith(line, F.lit("#")) | (F.regexp_count(line, F.lit(r"(?U)\S+")) > 20)
                                  | ~F.rlike(line, F.lit(r"[\d\-]")))).alias("stat_row"))
        return F.transform(rows, one)

    def close(acc, end):
        kind = F.when(acc["mode"] == 1, "markdown_table").otherwise("weapon_stats")
        keep = (acc["mode"] == 1) | ((acc["mode"] == 2) & (end - 1 > acc["start"]))
        return F.when(keep, F.concat(acc["out"], F.array(F.struct(
            acc["start"].alias("start_line"), (end - 1).alias("end_line"), kind.alias("table_type"))))
        ).otherwise(acc["out"])

    def step(acc, x):
        goes_on = (((acc["mode"] == 1) & ((x["i"] == acc["start"] + 1) | x["piped"]))
                   | ((acc["mode"] == 2) & x["stat_row"]))
        fresh = F.struct(
            F.when(x["opens_table"], 1).when(x["opens_stats"], 2).otherwise(0).alias("mode"),
            x["i"].alias("start"), close(acc, x["i"]).alias("out"))
        return F.when(goes_on, acc).otherwise(fresh)

    none = F.array().cast(TABLE_TYPE)
    zero = F.struct(F.lit(0).alias("mode"), F.lit(0).alias("start"))
    rows = F.transform(lines(text), strip)

    def ranges(r):
        return fold(classify(r), zero, ["mode", "start"], none, step, lambda acc: close(acc, F.size(r)))

    candidate = F.contains(text, F.lit("|")) | let(F.lower(text), lambda low: any_term(low, words))
    return F.when(candidate, let(rows, ranges)).otherwise(F.array().cast(TABLE_TYPE))


def detect_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.explode(table_ranges(F.col(text))).alias("_t")).select(*keep, "_t.*")


BLOCK_TYPE = "array<struct<type:string,start:int,n:int>>"


def content_blocks(content: Column, first_table_type: Column, stat_words=None) -> Column:
    """ARRAY<STRUCT<type, content>> of alternating text and table blocks of a section.

    ``first_table_type`` is the type of the document's first table, NULL when it has none.
    """
    words = stat_words or fv.BLOCK_STAT_WORDS

    def classify(line, i, stats):
        return F.struct(
            i.alias("i"),
            ((occurrences(line, "|") >= 2) | any_term(F.lower(line), words)).alias("opens"),
            (F.contains(line, F.lit("|")) | (strip(line) == "")
             | (stats & F.rlike(line, F.lit(r"[\d\-]")))).alias("continues"))

    def close(acc, end):
        return F.when(acc["kind"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
            acc["kind"].alias("type"), acc["start"].alias("start"), (end - acc["start"]).alias("n")))))

    def step(acc, x):
        in_table = F.coalesce(acc["kind"] == "table", F.lit(False))
        in_text = F.coalesce(acc["kind"] == "text", F.lit(False))
        stays = (in_table & x["continues"]) | (in_text & ~x["opens"])
        return F.when(stays, acc).otherwise(F.struct(
            F.when(x["opens"], "table").otherwise("text").alias("kind"),
            x["i"].alias("start"), close(acc, x["i"]).alias("out")))

    none = F.array().cast(BLOCK_TYPE)
    zero = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("start"))

    def cut(rows, stats):
        classified = F.transform(rows, lambda line, i: classify(line, i, stats))
        found = fold(classified, zero, ["kind", "start"], none, step, lambda acc: close(acc, F.size(rows)))
        return F.transform(found, lambda b: F.struct(
            b["type"].alias("type"),
            strip(F.array_join(F.slice(rows, b["start"] + 1, b["n"]), "\n")).alias("content")))

    plain = F.array(F.struct(F.lit("text").alias("type"), strip(content).alias("content")))
    def blocks_of(kind):
        tabled = let(lines(content), lambda rows: let(kind == "weapon_stats", lambda stats: cut(rows, stats)))
        return F.when(kind.isNull(), plain).otherwise(tabled)

    blocks = let(first_table_type, blocks_of)
    return F.filter(blocks, lambda b: b["content"] != "")
