"""Exact "text contains term" joins between two tables that may both be large.

A list of terms that fits a few automata (``plans/automaton.py``) is held by
every task, which walks each text once: nothing is exploded but the pairs
found.  A longer list is cut into slices of bounded size, each held as an index of first
bytes (``plans/prefixes.py``): one narrow pass over the texts a slice, and still no exploded
text.  Only a list of more than MOST_SLICES is joined through n-grams.  Instead of comparing every text with every term, each term is filed under one
of its character n-grams, the one fewest texts hold, and each text under all
of its n-grams.  Only pairs that meet on a gram are compared.  The result is
exact: a text that contains a term contains the term's gram.

Exploded rows hold the digest of a text and a gram, never the text; a text
travels once, to the candidates that are to be verified in it.  Joins are left
to the adaptive execution, which splits a gram or a text that very many rows share.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.functions.arrays import let
from corpusq.plans.automaton import matched_numbers, term_numbers
from corpusq.plans.bounded import TooLarge, small_rows
from corpusq.plans.prefixes import PrefixIndex

GRAM = 3
#: Terms that may come to the driver to be built into automata.
HELD_TERMS = 100_000
#: Terms of a slice in expectation, and slices that are walked before n-grams are cheaper.
SLICE_TERMS, MOST_SLICES = 300_000, 16


def _grams(column: Column, sizes) -> Column:
    """Distinct n-grams of the given sizes; linear in the length of the text."""
    def of(chars, size):
        last = F.size(chars) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)]))
    return let(F.split(column, ""), lambda chars: F.array_distinct(F.concat(*[of(chars, n) for n in sizes])))


def _anchor_grams(term: Column) -> Column:
    """The n-grams a term may be filed under: those of GRAM letters, or the whole of a shorter term."""
    return F.when(F.length(term) < GRAM, F.array(term)).otherwise(_grams(term, [GRAM]))


def held_pairs(texts: DataFrame, text: str, terms: DataFrame, term: str, limit: int = HELD_TERMS) -> DataFrame:
    """``texts`` with ``_term``, one row per distinct lower-case term that ``text`` contains; TooLarge for too many terms.

    A narrow stage: the text stays where it is, and a term that every text
    contains makes rows, but no key.
    """
    spark = texts.sparkSession
    rows = small_rows(terms.select(F.lower(F.col(term)).alias("t")).filter("t <> ''").distinct(), limit)
    listed = sorted(r["t"] for r in rows)
    return _numbered(texts, term_numbers(spark, F.lower(F.col(text)), listed), listed)


def _numbered(texts: DataFrame, number: Column, listed: list[str]) -> DataFrame:
    spark = texts.sparkSession
    names = F.broadcast(spark.createDataFrame(list(enumerate(listed)), "_number int, _term string"))  # one slice of terms at most
    return texts.withColumn("_number", F.explode(number)).join(names, "_number").drop("_number")


def sliced_pairs(texts: DataFrame, text: str, terms: DataFrame, term: str, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """As ``held_pairs`` for a list of terms too long for automata; TooLarge beyond MOST_SLICES slices."""
    distinct = terms.select(F.lower(F.col(term)).alias("t")).filter("t <> ''").distinct()
    slices = -(-distinct.count() // slice_terms)
    if slices > MOST_SLICES:
        raise TooLarge(f"more than {MOST_SLICES} slices of {slice_terms} terms")
    found = []
    for i in range(slices):
        # a slice by hash holds about slice_terms terms; each is let go before the next one comes
        listed = sorted(r["t"] for r in distinct.filter(F.pmod(F.xxhash64("t"), F.lit(slices)) == i).collect())
        if listed:
            index = PrefixIndex([t.encode() for t in listed])
            found.append(_numbered(texts, matched_numbers(texts.sparkSession, F.lower(F.col(text)), [index]), listed))
    return reduce(DataFrame.unionByName, found)


def contains_join(texts: DataFrame, text: str, terms: DataFrame, term: str, on: list[str] | None = None,
                  how: str = "inner", held_terms: int = HELD_TERMS) -> DataFrame:
    """Pairs where ``text`` contains ``term`` (case folded), equal on ``on``.

    ``how`` may be "inner" or "left_terms" (keep terms without a match).
    Rows of both inputs are kept whole; ``texts`` and ``terms`` must not share
    column names other than ``on``.  Nulls and empty terms match nothing.  Up
    to ``held_terms`` distinct terms are walked by automata.
    """
    on = on or []
    terms = terms.withColumn("_term", F.lower(F.col(term)))
    try:
        pairs = terms.join(held_pairs(texts, text, terms, term, held_terms), ["_term", *on])
    except TooLarge:
        pairs = _long_list_pairs(texts, text, terms, term, on) if held_terms else _gram_pairs(texts, text, terms, on)
    if how == "inner":
        return pairs.drop("_term")
    keys = terms.columns
    missed = terms.join(pairs.select(*keys).distinct(), keys, "left_anti")
    return pairs.unionByName(missed, allowMissingColumns=True).drop("_term")


def _long_list_pairs(texts: DataFrame, text: str, terms: DataFrame, term: str, on: list[str]) -> DataFrame:
    try:
        return terms.join(sliced_pairs(texts, text, terms, term), ["_term", *on])
    except TooLarge:
        return _gram_pairs(texts, text, terms, on)


def _gram_pairs(texts: DataFrame, text: str, terms: DataFrame, on: list[str]) -> DataFrame:
    texts = texts.withColumn("_text", F.lower(F.col(text))).withColumn("_tid", F.unhex(F.md5(F.col("_text").cast("binary"))))
    per_term = (terms.select("_term").filter("_term <> ''").distinct()
                .select("_term", F.explode(_anchor_grams(F.col("_term"))).alias("_gram")))
    wanted = per_term.select("_gram").distinct()
    held = (texts.filter("_text <> ''").select("_tid", F.explode(_grams(F.col("_text"), range(1, GRAM + 1))).alias("_gram"))
            .join(wanted, "_gram", "left_semi"))
    frequency = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
    # a gram that no text holds is the best anchor: its term occurs nowhere
    anchors = (per_term.join(frequency, "_gram", "left").groupBy("_term")
               .agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("h"), "_gram")).alias("_best"))
               .filter("_best.h > 0").select("_term", F.col("_best._gram").alias("_gram")))
    candidates = held.join(anchors, "_gram").select("_tid", "_term").distinct()
    verified = texts.join(candidates, "_tid").filter(F.contains(F.col("_text"), F.col("_term"))).drop("_tid", "_text")
    return terms.join(verified, ["_term", *on])
