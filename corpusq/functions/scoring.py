"""Lexicon scoring as Column expressions.

A lexicon is a short list of (category, term, weight) known when the plan is
built, so every test is a literal inside generated code: one pass over the
text, no join, no shuffle.  Weights are summed as whole thousandths and become
DECIMAL once per score, so sums are exact and cheap.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.text import _col, any_term

SCORE = "decimal(9,3)"


def _weight(value) -> Column:
    return F.lit(str(value)).cast(SCORE)


def _total(tests) -> Column:
    """Sum of the weights of the tests that hold."""
    points = reduce(lambda a, b: a + b, [F.when(test, F.lit(round(w * 1000))).otherwise(F.lit(0)) for test, w in tests], F.lit(0))
    return (points.cast("decimal(9,0)") * F.lit("0.001").cast("decimal(4,3)")).cast(SCORE)


def term_score(column, weighted_terms) -> Column:
    """Sum of the weights of the terms contained in the (already folded) column."""
    col = _col(column)
    return _total([(F.contains(col, F.lit(t)), w) for t, w in weighted_terms])


def pattern_score(column, weighted_patterns, flags: str = "(?U)") -> Column:
    """Sum of the weights of the patterns that match at least once."""
    col = _col(column)
    return _total([(F.rlike(col, F.lit(flags + p)), w) for p, w in weighted_patterns])


def found_terms(column, terms, limit: int | None = None) -> Column:
    """The terms contained in the column, in lexicon order."""
    col = _col(column)
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(col, t))
    return F.slice(found, 1, limit) if limit else found


def capped(score: Column, cap) -> Column:
    return F.least(score, _weight(cap))


def best_label(scored) -> Column:
    """Label of the highest score; the first one declared wins a tie."""
    options = [F.struct(score.alias("score"), F.lit(-i).alias("ord"), F.lit(label).alias("label"))
               for i, (label, score) in enumerate(scored)]
    return F.array_max(F.array(*options))


# ---- detectors ------------------------------------------------------------------------
def _detector(total: Column, threshold: float, scale: float, found: Column, marked: Column) -> Column:
    return F.struct(
        (total >= _weight(threshold)).alias("is_content"),
        F.least(total.cast("double") / scale, F.lit(1.0)).alias("confidence"),
        found.alias("found"), marked.alias("format_seen"), total.alias("total_score"))


def detect_spell(column, names=None, formats=None, mechanics=None, context=None) -> Column:
    col, low = _col(column), F.lower(_col(column))
    names = fv.SPELL_NAMES if names is None else names
    formats = pattern_score(col, [(p, 2.0) for p in (fv.SPELL_FORMATS if formats is None else formats)], "(?idU)")
    total = (formats + term_score(low, [(t, 1.0) for t in names])
             + capped(term_score(low, [(t, 0.5) for t in (fv.SPELL_MECHANICS if mechanics is None else mechanics)]), 5)
             + capped(term_score(low, [(t, 0.3) for t in (fv.SPELL_CONTEXT if context is None else context)]), 3))
    return _detector(total.cast(SCORE), 2.0, 10.0, found_terms(low, names, 5), formats > 0)


def detect_ic(column, names=None, attacks=None, attributes=None, context=None) -> Column:
    col, low = _col(column), F.lower(_col(column))
    names = fv.IC_NAMES if names is None else names
    marks = pattern_score(col, [(p, 3.0) for p in (fv.IC_ATTACKS if attacks is None else attacks)], "(?idU)")
    total = (marks + term_score(low, [(t.lower(), 1.5) for t in names])
             + capped(term_score(low, [(t, 0.5) for t in (fv.IC_ATTRIBUTES if attributes is None else attributes)]), 4)
             + capped(term_score(low, [(t, 0.3) for t in (fv.IC_CONTEXT if context is None else context)]), 2))
    return _detector(total.cast(SCORE), 2.0, 10.0, found_terms(low, names), marks > 0)


def detect_weapon(column, names=None, tables=None, makers=None) -> Column:
    col, low = _col(column), F.lower(_col(column))
    names = fv.WEAPON_NAMES if names is None else names
    marks = pattern_score(col, [(p, 3.0) for p in (fv.WEAPON_TABLES if tables is None else tables)], "(?idU)")
    total = (marks + term_score(low, [(t.lower(), 1.0) for t in names])
             + capped(term_score(low, [(t.lower(), 0.5) for t in (fv.WEAPON_MAKERS if makers is None else makers)]), 3))
    return _detector(total.cast(SCORE), 1.5, 8.0, found_terms(low, names, 5), marks > 0)


# ---- ordered rules -------------------------------------------------------------------------
def role_to_section(column) -> Column:
    role = F.replace(F.lower(_col(column)), F.lit(" "), F.lit("_"))
    chain = F
    for name, section in fv.ROLE_SECTIONS.items():
        chain = chain.when(role == name, F.lit(section))
    return chain.otherwise(F.lit(None).cast("string"))


def map_attribute(column) -> Column:
    low = F.lower(_col(column))
    chain = F.when(low.isNull() | (low == ""), F.lit(""))
    for short, full in fv.ATTRIBUTE_ABBREVIATIONS.items():
        chain = chain.when(low == short, F.lit(full))
    return chain.otherwise(low)


def firing_modes(column, patterns=None) -> Column:
    low = F.lower(_col(column))
    flags = [F.when(F.rlike(low, F.lit("(?U)" + p)), F.lit(name)) for name, p in (patterns or fv.FIRING_MODES)]
    return F.filter(F.array(*flags), lambda m: m.isNotNull())


def clear_phrase(column) -> Column:
    return any_term(column, fv.CLEAR_QUERY_PHRASES)
