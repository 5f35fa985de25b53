"""Inputs derived from the given tables, written twice: as a DataFrame and as SQL."""

from pyspark.sql import functions as F

from corpusq.plans.once import compute_once
from corpusq.session import load, load_spread

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def sql_strip(expr):
    return STRIP.format(expr)


def sql_any(expr, terms):
    return "(" + " OR ".join(f"contains({expr}, '{sql_text(t)}')" for t in terms) + ")"


def sql_count(expr, terms):
    return "(" + " + ".join(f"contains({expr}, '{sql_text(t)}')::INT" for t in terms) + ")"


def sql_text(value):
    return value.replace("'", "''")


def documents(spark, sf):
    return load_spread(spark, sf, "documents", "doc_id")


# markdown headers at line starts
MD_SQL = r"""SELECT doc_id, source, lang, 'lib/' || source || '/doc-' || doc_id || '.md' AS doc_path,
  regexp_replace(regexp_replace(text, '(^|\n)([A-D])', '\1# \2', 'g'), '(^|\n)([E-G])', '\1## \2', 'g') AS text
  FROM documents"""


def md_docs(spark, sf):
    text = F.regexp_replace(F.regexp_replace("text", r"(^|\n)([A-D])", "$1# $2"), r"(^|\n)([E-G])", "$1## $2")
    return compute_once(documents(spark, sf), "text", text).select(
        "doc_id", "source", "lang",
        F.concat(F.lit("lib/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"), "text")


# numbered, capital and header lines
OUTLINE_SQL = r"""SELECT doc_id, replace(regexp_replace(regexp_replace(text, '(^|\n)([A-C])', '\1' || '1. \2', 'g'),
  '(^|\n)([D-F])', '\1## \2', 'g'), '.' || chr(10), '.' || chr(10) || 'MAJOR SECTION HEAD' || chr(10)) AS text
  FROM documents"""


def outline_docs(spark, sf):
    text = F.regexp_replace(F.regexp_replace("text", r"(^|\n)([A-C])", r"$1\1. $2"),
                            r"(^|\n)([D-F])", "$1## $2")
    return compute_once(documents(spark, sf), "text", F.replace(
        text, F.lit(".\n"), F.lit(".\nMAJOR SECTION HEAD\n"))).select("doc_id", "text")


# piped tables, separator rows and stat lines
TABLE_SQL = r"""SELECT doc_id, 'lib/doc-' || doc_id || '.md' AS doc_path,
  replace(replace(replace(text, ', ', ' | '), '.' || chr(10), ' |' || chr(10) || '|---|' || chr(10)),
          '. ', '.' || chr(10)) AS text FROM documents"""


def table_docs(spark, sf):
    text = F.replace(F.replace(F.replace("text", F.lit(", "), F.lit(" | ")), F.lit(".\n"), F.lit(" |\n|---|\n")),
                     F.lit(". "), F.lit(".\n"))
    return compute_once(documents(spark, sf), "text", text).select(
        "doc_id", F.concat(F.lit("lib/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"), "text")


# every kind of extraction dirt
DIRT_HEAD = "12 nav words >>\n>\n<< The Index 14\n"
DIRT_TAIL = "\n\n\n\n![](a.png) tail \t end (see p. 7).  Ã¢â‚¬Â¢ Ã‚ x*\\* See Foo, p. 3* \n"
DIRT_SWAPS = [(" of ", " (see **Book**, p. 160) of "), (" the ", " <i>the</i> (p. 12) "),
              (" la ", " **Bold Ref**, p. 9. la Page 33 "), (" and ", " **p. 4** and Ã¢â‚¬Â¦ ")]


def sql_literal(text):
    parts = []
    for piece in text.split("\n"):
        parts.append("'" + piece.replace("'", "''") + "'")
    return " || chr(10) || ".join(parts)


def _dirty_sql():
    expr = "text"
    for old, new in DIRT_SWAPS:
        expr = f"replace({expr}, '{old}', '{new}')"
    return f"SELECT doc_id, {sql_literal(DIRT_HEAD)} || {expr} || {sql_literal(DIRT_TAIL)} AS text FROM documents"


DIRTY_SQL = _dirty_sql()


def dirty_docs(spark, sf):
    text = F.col("text")
    for old, new in DIRT_SWAPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return compute_once(documents(spark, sf), "text", F.concat(F.lit(DIRT_HEAD), text, F.lit(DIRT_TAIL))).select("doc_id", "text")


# conversations as the ordered chunks of a document
CHUNKS_SQL = """SELECT 'lib/conv-' || conv_id || '.md' AS doc_path, turn AS chunk_pos, role AS section_index,
  conv_id || '_' || turn AS chunk_id, text, conv_id, turn, role FROM conversations"""


def conversation_chunks(spark, sf):
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return load(spark, sf, "conversations").select(
        F.concat(F.lit("lib/conv-"), conv, F.lit(".md")).alias("doc_path"), F.col("turn").alias("chunk_pos"),
        F.col("role").alias("section_index"), F.concat(conv, F.lit("_"), turn).alias("chunk_id"), "text",
        "conv_id", "turn", "role")
