"""Per-chunk quality, type and table tests as Column expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.text import _col, any_term, count_terms, lines, strip, strip_left

SENTENCE_ENDS = ".!?"


def occurrences(column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    col = _col(column)
    return ((F.length(col) - F.length(F.replace(col, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def starts_mid_sentence(column) -> Column:
    return F.rlike(F.left(strip_left(column), F.lit(1)), F.lit(r"^\p{Ll}"))


def ends_mid_sentence(column) -> Column:
    text = strip(column)
    return (text != "") & ~F.substring(text, -1, 1).isin(*SENTENCE_ENDS)


def ends_sentence(column) -> Column:
    """``[.!?]$`` by the last characters only; a final line end of one or two characters may follow."""
    text = _col(column)
    return reduce(lambda a, b: a | b, [F.endswith(text, F.lit(e)) for e in SENTENCE_ENDS]) | F.rlike(F.substring(text, -3, 3), F.lit(r"[.!?]$"))


def boundary_quality(column) -> Column:
    starts, ends = starts_mid_sentence(column), ends_mid_sentence(column)
    return (F.when(~starts & ~ends, "excellent").when(~starts | ~ends, "good").otherwise("poor"))


def is_table_content(column) -> Column:
    col = _col(column)
    piped = F.contains(col, F.lit("\n|")) & (occurrences(col, "|") > 5) & (occurrences(col, "\n|") > 1)
    # the words first: what only the second side of an "or" holds is not shared, and the text would be lower-cased for each word
    return (count_terms(F.lower(col), fv.TABLE_STAT_WORDS) >= 3) | piped


def contains_tables(column) -> Column:
    col = _col(column)
    piped = (occurrences(col, "|") >= 6) & (occurrences(col, "\n|") >= 2)
    return piped | any_term(F.lower(col), fv.TABLE_STAT_WORDS)


def chunk_type(column) -> Column:
    col = _col(column)
    low = F.lower(col)
    return (F.when(is_table_content(col), "table")
            .when(any_term(low, fv.RULE_TERMS), "rule")
            .when(any_term(low, fv.EXAMPLE_TERMS), "example")
            .when((occurrences(col, "\n-") > 2) | (occurrences(col, "\n•") > 2), "list")
            .otherwise("narrative"))


def header_level(column) -> Column:
    line = _col(column)
    return (F.when(F.startswith(line, F.lit("#")), F.length(F.regexp_extract(line, "^(#+)", 1)))
            .when(F.contains(line, F.lit("|")) & any_term(F.upper(line), fv.TABLE_SECTION_WORDS), 2)
            .when((F.length(line) > 10) & (line == F.upper(line)) & (line != F.lower(line)), 1)
            .when(F.rlike(line, F.lit(r"^\d+\.")), 2)
            .otherwise(3))


# ---- analysis flags -----------------------------------------------------------------
def _kept(column, keep) -> Column:
    return F.filter(lines(strip(column)), keep)


def is_empty_chunk(column) -> Column:
    return F.length(strip(column)) < 50


def is_header_only(column) -> Column:
    content = _kept(column, lambda l: ~F.startswith(strip(l), F.lit("#")) & (F.length(strip(l)) > 10))
    return F.size(content) <= 2


def has_incomplete_sentence(column) -> Column:
    return ~F.rlike(strip(column), F.lit(r"[.!?]$"))


def is_orphan_header(column) -> Column:
    headers = _kept(column, lambda l: F.startswith(strip(l), F.lit("#")))
    content = _kept(column, lambda l: ~F.startswith(strip(l), F.lit("#")) & (F.length(strip(l)) > 5))
    return (F.size(headers) >= 1) & (F.size(content) <= 1)


def is_missing_context(column, context_words=None) -> Column:
    col = _col(column)
    return (F.length(col) <= 100) & ~any_term(F.lower(col), context_words or fv.CONTEXT_WORDS)


def splits_mid_sentence(column) -> Column:
    text = lines(strip(column))
    first, last = strip(F.element_at(text, 1)), strip(F.element_at(text, -1))
    starts = F.rlike(first, F.lit(r"^\p{Ll}")) & (F.length(first) > 10)
    ends = ~F.rlike(last, F.lit(r"[.!?:;]$")) & (F.length(last) > 5)
    return starts | ends


def splits_mid_table(column) -> Column:
    table_lines = _kept(column, lambda l: occurrences(l, "|") > 1)
    head = F.exists(
        F.slice(lines(strip(column)), 1, 3),
        lambda l: F.contains(l, F.lit("---"))
        | (F.startswith(strip(l), F.lit("|")) & F.endswith(strip(l), F.lit("|"))))
    return (F.size(table_lines) > 0) & ~head


def example_or_rule(column) -> Column:
    low = F.lower(_col(column))
    example, rule = any_term(low, fv.ANALYSIS_EXAMPLES), any_term(low, fv.ANALYSIS_RULES)
    return F.when(example & ~rule, "examples_only").when(rule & ~example, "rules_only").otherwise("unclear_or_mixed")


def has_cross_reference_issue(column) -> Column:
    col = _col(column)
    return F.rlike(F.lower(col), F.lit(fv.CROSS_REFERENCE)) & (
        F.contains(col, F.lit("MISSING")) | (F.length(col) < 200))
