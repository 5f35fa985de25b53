"""Text cleaning, splitting and title expressions.

Every function takes and returns a Column, so Catalyst keeps the whole chain
in one projection.  Patterns run with (?d) (only \\n ends a line) and (?U)
(Unicode classes), which is how the fixed patterns are meant.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.arrays import let

UNICODE = "(?dU)"
MULTILINE = "(?dmU)"
# what (?U)\s matches
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
# a private-use character stands in for "<<" while tags are removed
HELD_MARKER = "\ue000"


def _col(column):
    return F.col(column) if isinstance(column, str) else column


def remove(column, pattern: str, flags: str = UNICODE) -> Column:
    return F.regexp_replace(_col(column), flags + pattern, "")


def strip(column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(_col(column), F.lit(WHITE_SPACE))


def strip_left(column) -> Column:
    return F.ltrim(_col(column), F.lit(WHITE_SPACE))


def any_term(column, terms) -> Column:
    """True when any literal term occurs in the column (no case folding)."""
    return reduce(lambda a, b: a | b, [F.contains(_col(column), F.lit(t)) for t in terms], F.lit(False))


def count_terms(column, terms) -> Column:
    """How many of the terms occur (presence, not frequency)."""
    return reduce(lambda a, b: a + b, [F.contains(_col(column), F.lit(t)).cast("int") for t in terms], F.lit(0))


def first_match(column, rules, default) -> Column:
    """First label whose term list has a term contained in the column."""
    chain = F
    for label, terms in rules:
        chain = chain.when(any_term(column, terms), F.lit(label))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def quoted(column) -> Column:
    """The column's value as a literal inside a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(_col(column), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


# ---- cleaning steps -----------------------------------------------------------
def hold_nav_markers(column) -> Column:
    return F.regexp_replace(_col(column), UNICODE + fv.NAV_MARKER, HELD_MARKER + " $1 $2")


def release_nav_markers(column) -> Column:
    return F.regexp_replace(_col(column), UNICODE + HELD_MARKER + r"\s+([^>]+?)\s+(\d+)", "<< $1 $2")


def strip_tags(column) -> Column:
    return remove(column, fv.TAG)


def remove_page_references(column) -> Column:
    return reduce(remove, fv.PAGE_REFERENCES, _col(column))


def remove_image_references(column) -> Column:
    return remove(column, fv.IMAGE_REFERENCE)


def remove_breadcrumbs(column) -> Column:
    return remove(column, fv.BREADCRUMB_LINE, MULTILINE)


def remove_escaped_references(column) -> Column:
    return remove(column, fv.ESCAPED_CROSS_REFERENCE)


def remove_bold_references(column) -> Column:
    return remove(column, fv.BOLD_PAGE_REFERENCE)


def remove_quote_only_lines(column) -> Column:
    return remove(column, fv.QUOTE_ONLY_LINE, MULTILINE)


def remove_simple_references(column) -> Column:
    return remove(column, fv.SIMPLE_PAGE_REFERENCE)


def repair_mojibake(column, longest_first: bool = False, repairs=None) -> Column:
    repairs = list(repairs or fv.MOJIBAKE)
    if longest_first:
        repairs = sorted(repairs, key=lambda pair: -len(pair[0]))
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), repairs, _col(column))


def squeeze_whitespace(column) -> Column:
    text = F.regexp_replace(_col(column), UNICODE + r"\n\s*\n\s*\n+", "\n\n")
    # a single blank stays as it is, so most texts are not written anew
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    return strip(F.replace(text, F.lit(" \n"), F.lit("\n")))


CLEANING_STEPS = [
    hold_nav_markers, strip_tags, release_nav_markers, remove_page_references, remove_image_references,
    remove_breadcrumbs, remove_escaped_references, remove_bold_references, remove_quote_only_lines,
    remove_simple_references, repair_mojibake, squeeze_whitespace,
]
#: Pieces of which a text must contain one for the step to change it.
STEP_PIECES = {
    hold_nav_markers: ["<<"], strip_tags: ["<"], release_nav_markers: [HELD_MARKER],
    remove_page_references: ["(see", "(p.", "(P.", "**p.", "**P.", "page", "Page"], remove_image_references: ["![]("],
    remove_breadcrumbs: [">>"], remove_escaped_references: ["\\*"], remove_bold_references: ["**,"],
    remove_quote_only_lines: [">"], remove_simple_references: ["(see"],
    repair_mojibake: sorted({broken[0] for broken, _ in fv.MOJIBAKE}),
}


def clean_text(column) -> Column:
    """All cleaning steps in order; a step's patterns run only over a text that holds one of its pieces."""
    def applied(text, step):
        pieces = STEP_PIECES.get(step)
        return let(text, lambda t: F.when(any_term(t, pieces), step(t)).otherwise(t) if pieces else step(t))
    return reduce(applied, CLEANING_STEPS, _col(column))


# ---- splitting and counting ------------------------------------------------------
def lines(column) -> Column:
    return F.split(_col(column), "\n")


def split_sentences(column) -> Column:
    return F.split(_col(column), r"(?U)\s(?<=[.!?]\s)\s*")


def split_paragraphs(column) -> Column:
    parts = F.split(_col(column), r"(?dU)\n\s*\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def count_tokens(column) -> Column:
    """White-space tokens: the text is shortened to one character a token, because matches that are gathered cost more."""
    return F.length(F.regexp_replace(_col(column), r"(?U)\s*+(\S)\S*+\s*+|\s++", "$1"))


def estimate_chunks(column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    return F.greatest(F.lit(1), F.floor(count_tokens(column) / F.lit(size - overlap)).cast("int"))


# ---- titles and file names ----------------------------------------------------------
def _capitalise(word) -> Column:
    """A first letter that is several in upper case keeps only the first of them large (ß gives Ss)."""
    first = F.upper(F.substring(word, 1, 1))
    return F.concat(F.substring(first, 1, 1), F.lower(F.concat(F.substring(first, 2, 8), F.substring(word, 2, 1 << 30))))


def normalise_title(column, variations=None, special_cases=None) -> Column:
    """Known spelling as written, known spelling upper-cased, else per-word casing."""
    variations = fv.TITLE_VARIATIONS if variations is None else variations
    special_cases = fv.TITLE_SPECIAL_CASES if special_cases is None else special_cases

    def cased(word):
        upper = F.upper(word)
        return (F.when(upper.isin(fv.ROMAN_NUMERALS), upper)
                .when((F.length(word) > 3) | upper.isin(fv.CAPITALISED_SHORT_WORDS), _capitalise(word))
                .otherwise(F.lower(word)))

    def known(spellings, title):
        if not spellings:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair]), title)

    return let(strip(column), lambda title: F.coalesce(
        known(variations, title), known(special_cases, F.upper(title)),
        F.array_join(F.transform(F.split(title, r"(?U)\s+"), cased), " ")))


def title_case(column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    parts = F.regexp_extract_all(_col(column), F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, _capitalise), "")


def safe_file_title(column, limit: int = 50) -> Column:
    safe = F.regexp_replace(_col(column), r'[<>:"/\\|?*]', "")
    safe = F.regexp_replace(safe, r"(?U)\s+", "_")
    safe = F.left(F.regexp_replace(safe, r"^[._]+|[._]+$", ""), F.lit(limit))
    return F.when(safe == "", F.lit("untitled")).otherwise(safe)


def file_stem(column) -> Column:
    name = F.substring_index(_col(column), "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_name(column) -> Column:
    return F.substring_index(_col(column), "/", -1)


def safe_file_name(stem, number, title) -> Column:
    digits = _col(number).cast("string")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.concat(_col(stem), F.lit("-"), padded, F.lit("-"), safe_file_title(title), F.lit(".md"))


def classify_title(column, rules=None) -> Column:
    return first_match(F.lower(_col(column)), rules or fv.TITLE_SECTIONS, "General")


def content_fingerprint(column) -> Column:
    return F.md5(_col(column))
