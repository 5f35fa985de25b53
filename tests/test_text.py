from pyspark.sql import functions as F
import pytest

from corpusq.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr("t").alias("x")).first()["x"]


@pytest.mark.parametrize("dirty,clean", [
    ("<< The Index 14 <b>x</b>", "<< The Index 14 x"),
    ("a (see **Rules**, p. 12) b", "a b"),
    ("a (p. 3) b (P.4) c", "a b c"),
    ("see **p. 9** Page 33 end", "see end"),
    ("x ![](img/a.png) y ![alt](b.png)", "x y ![alt](b.png)"),
    ("keep\n12 some words >>\nend", "keep\n\nend"),
    ("a\n > \nb", "a\n\nb"),
    ("**Bold**, p. 4. rest", "rest"),
    ("a (see p. 7). b", "a b"),
    ("Ã¢â‚¬Â¢ item", "\"Â¢ item"),
    ("a\n\n\n\nb  c\t d  ", "a\n\nb c d"),
    ("  \n ", ""),
    (" x ", "x"),
])
def test_clean_text(spark, dirty, clean):
    assert one(spark, dirty, T.clean_text) == clean


def test_mojibake_order_and_longest_first(spark):
    assert one(spark, "Ã¢â‚¬Â¦", T.repair_mojibake) == "\"Â¦"
    assert one(spark, "Ã¢â‚¬Â¦", lambda c: T.repair_mojibake(c, longest_first=True)) == "..."


@pytest.mark.parametrize("value,n", [("", 0), ("  ", 0), ("a", 1), ("a b", 2), (" a  b\nc ", 3)])
def test_count_tokens(spark, value, n):
    assert one(spark, value, T.count_tokens) == n


def test_sentences_and_paragraphs(spark):
    assert one(spark, "A b. C!  D? e", T.split_sentences) == ["A b.", "C!", "D?", "e"]
    assert one(spark, "a\n \n b \n\n\n\nc", T.split_paragraphs) == ["a", "b", "c"]


@pytest.mark.parametrize("title,wanted", [
    ("SOCIAL SKILLS", "Social Skills"), ("ic", "IC"), ("pans and wans", "PANs and WANs"), ("part vii of the END", "Part VII of The end"),
    ("a GREAT day", "a Great day")])
def test_normalise_title(spark, title, wanted):
    assert one(spark, title, T.normalise_title) == wanted


@pytest.mark.parametrize("title,wanted", [
    ('a/b: c?', "ab_c"), ("...", "untitled"), ("x" * 60, "x" * 50), ("_ hi _", "hi")])
def test_safe_file_title(spark, title, wanted):
    assert one(spark, title, T.safe_file_title) == wanted


def test_title_case_follows_every_non_letter(spark):
    assert one(spark, "o'neil ak-97 (big)", T.title_case) == "O'Neil Ak-97 (Big)"


WHITE = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() and not 0x1C <= c <= 0x1F or c == 0x85)]


def test_strip_takes_all_white_space_and_nothing_else(spark):
    rows = [(c, f"{chr(c)}a{chr(c)}") for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame(rows, "c int, t string").select("c", T.strip("t").alias("s"), T.strip_left("t").alias("l"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("r"))
    assert got.filter("s <> r").count() == 0
    assert {chr(r["c"]) for r in got.filter("s = 'a'").collect()} == {chr(r["c"]) for r in got.filter("startswith(l, 'a')").collect()} - {"a"} == set(WHITE)


def test_faster_forms_equal_their_patterns(spark):
    """Token counts, sentence cuts, sentence ends and blanks of random strings, beside the plain patterns."""
    import random
    from corpusq.functions import quality as Q
    dice = random.Random(5)
    letters = ["a", "É", "z", "𝒳", ".", "!", "?", " ", " ", "\t", "\n", "\r", "\r\n", "\xa0", " ", "\x85"]
    rows = [("".join(dice.choices(letters, k=dice.randrange(0, 14))),) for _ in range(4000)]
    got = spark.createDataFrame(rows, "t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"(?dU)\n\s*\n\s*\n+", "\n\n"), r"[ \t]+", " "), r"(?dm)[ \t]+$", "")
    both = {
        "tokens": (T.count_tokens("t"), F.regexp_count("t", F.lit(r"(?U)\S+"))),
        "sentences": (T.split_sentences("t"), F.split("t", r"(?U)(?<=[.!?])\s+")),
        "ends": (Q.ends_sentence("t"), F.rlike("t", F.lit(r"[.!?]$"))),
        "starts": (Q.starts_mid_sentence("t"), F.rlike(plain, F.lit(r"^\p{Ll}"))),
        "mid": (Q.ends_mid_sentence("t"), (plain != "") & ~F.rlike(plain, F.lit(r"[.!?]$"))),
        "squeezed": (T.squeeze_whitespace("t"), F.regexp_replace(squeezed, r"(?U)^\s+|\s+$", ""))}
    for name, (fast, slow) in both.items():
        assert got.filter(~fast.eqNullSafe(slow)).limit(1).collect() == [], name


def test_cleaning_step_by_step_equals_the_guarded_chain(spark):
    import random
    dice = random.Random(6)
    pieces = ["<< ", "Go 3", "<b>", "> ", "\n", "(see **A**, p. 3)", "(p. 4)", "**p. 5**", "page 6", "![](a.png)", "12 ab >>", "* \\* See x, p. 7*",
              "**B**, p. 8.", "(see p. 9).", "Ã¢â‚¬", "Ã‚ ", " ", "pa", "ge 10", " q 4", "(s", "ee p. 2)", "\n\n\n", "word. "]
    rows = [("".join(dice.choices(pieces, k=dice.randrange(1, 9))),) for _ in range(2000)]
    got = spark.createDataFrame(rows, "t string").withColumn("u", F.col("t"))
    for step in T.CLEANING_STEPS:
        got = got.withColumn("u", step(F.col("u"))).localCheckpoint()
    assert got.filter(~T.clean_text("t").eqNullSafe(F.col("u"))).limit(1).collect() == []


def test_numbered_lines_are_cleaned_in_linear_time(spark):
    """The pattern of breadcrumb lines reads on from every line that begins with a number; here no breadcrumb can be."""
    import time
    df = spark.createDataFrame([("12 some words\n" * 20000,)], "t string")
    start = time.time()
    assert df.select(F.length(T.clean_text("t")).alias("n")).first()["n"] == 20000 * 14 - 1
    assert time.time() - start < 10
