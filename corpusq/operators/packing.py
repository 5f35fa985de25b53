"""Token-budgeted packing of sentences, paragraphs and table lines.

Each function folds the units of one section inside its row, in blocks, so that
the time is linear in the units.  The fold keeps unit indexes, never text; text
is joined once per finished chunk.

``tokens`` maps ARRAY<STRING> to ARRAY<INT>; the default counts white-space
tokens in place, a registered tokenizer counts whole arrays in Arrow batches.
"""

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.arrays import at, fold, indexes, ints, let, total
from corpusq.functions.quality import boundary_quality, chunk_type, contains_tables, ends_sentence, is_table_content
from corpusq.functions.text import any_term, count_tokens, lines, split_paragraphs, split_sentences, strip


def token_counts(texts: Column) -> Column:
    return F.transform(texts, count_tokens)


# ---- large tables ---------------------------------------------------------------------
def _line_tests(header_words=None):
    """(is_header, is_data) of a table line; they exclude each other."""
    words = header_words or fv.TABLE_HEADER_WORDS

    def is_header(line):
        return F.contains(line, F.lit("|")) & any_term(F.lower(line), words)

    def is_data(line):
        return ~is_header(line) & (F.contains(line, F.lit("|")) | F.rlike(line, F.lit(r"\d+[PS]|\d+¥")))
    return is_header, is_data


def split_table_drops(content: Column, header_words=None) -> Column:
    """STRUCT<lines, blocks>: what ``split_large_table`` leaves out of the chunks of the same content.

    Lines that are neither header nor data are dropped, and a block without a
    data line whole.  Blank lines are no loss.
    """
    is_header, is_data = _line_tests(header_words)

    def drops(parts):
        filled = F.filter(parts, lambda l: strip(l) != "")
        other = F.size(F.filter(filled, lambda l: ~is_header(l) & ~is_data(l)))
        whole = (F.size(filled) > 0) & ~F.exists(filled, is_data)
        return F.struct(F.when(whole, F.size(filled)).otherwise(other).alias("lines"), whole.cast("int").alias("blocks"))
    return let(lines(content), drops)


def split_large_table(content: Column, rows: int = fv.TABLE_ROWS_PER_CHUNK, header_words=None) -> Column:
    """ARRAY<STRUCT<text, token_count, chunk_type>>: ``rows`` data rows each, header rows repeated.

    ``split_table_drops`` counts the lines and blocks that are in no chunk.
    """
    is_header, is_data = _line_tests(header_words)

    def groups(parts):
        header, data = F.filter(parts, is_header), F.filter(parts, is_data)

        def group(d, h):
            first = F.filter(indexes(d), lambda i: i % rows == 0)
            return F.transform(first, lambda i: F.array_join(F.concat(h, F.slice(d, i + 1, rows)), "\n"))
        return let(data, lambda d: let(header, lambda h: group(d, h)))

    return F.transform(let(lines(content), groups), lambda t: F.struct(
        t.alias("text"), count_tokens(t).alias("token_count"), F.lit("table_split").alias("chunk_type")))


# ---- sentences with overlap --------------------------------------------------------------
def _units(blocks: Column, tokens) -> Column:
    def of_block(b):
        table = F.array(F.struct(F.lit(True).alias("table"), b["content"].alias("content")))
        text = F.transform(split_sentences(b["content"]), lambda s: F.struct(
            F.lit(False).alias("table"), s.alias("content")))
        return F.when(b["type"] == "table", table).otherwise(text)
    units = F.flatten(F.transform(blocks, of_block))
    counts = tokens(F.transform(units, lambda u: u["content"]))
    return F.zip_with(units, counts, lambda u, t: F.struct(
        u["table"].alias("table"), u["content"].alias("content"), t.alias("t"),
        (u["table"] | ends_sentence(u["content"])).alias("ends")))


def overlap_units(run: Column, units: Column, overlap: int) -> Column:
    """Longest tail of the unit run whose tokens fit the overlap; cuts only after a sentence end."""
    marked = F.transform(run, lambda u, k: F.struct(
        at(units, u)["t"].alias("t"),
        ((k == 0) | F.coalesce(at(units, at(run, k - 1))["ends"], F.lit(True))).alias("opens")))

    def step(acc, x):
        n, used = acc["n"] + 1, acc["used"] + x["t"]
        return F.struct(n.alias("n"), used.alias("used"),
                        F.when((used <= overlap) & x["opens"], n).otherwise(acc["best"]).alias("best"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(0).alias("best"))
    best = F.aggregate(F.reverse(marked), zero, step)["best"]
    return let(best, lambda b: F.when(b > 0, F.slice(run, -b, b)).otherwise(ints()))


def pack_sentences(blocks: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP,
                   table_rows: int = fv.TABLE_ROWS_PER_CHUNK, tokens=token_counts) -> Column:
    """ARRAY<STRUCT<text, token_count, chunk_type>> of a section's content blocks."""

    def packed(units):
        def emitted(acc, kind):
            return F.when(F.size(acc["cur"]) == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                acc["cur"].alias("units"), acc["tok"].alias("tokens"), F.lit(kind).alias("kind")))))

        def state(cur, tok, run, last_text, out):
            return F.struct(cur.alias("cur"), tok.alias("tok"), run.alias("run"),
                            last_text.alias("last_text"), out.alias("out"))

        def step(acc, x):
            i, t = ints(x["i"]), x["t"]
            full = acc["tok"] + t > size
            none, yes, no = ints(), F.lit(True), F.lit(False)
            split_out = F.concat(emitted(acc, "mixed"), F.array(F.struct(
                i.alias("units"), t.alias("tokens"), F.lit("table_split").alias("kind"))))
            table = (F.when(t > size, state(none, F.lit(0), none, no, split_out))
                     .when(full, state(i, t, none, no, emitted(acc, "mixed")))
                     .otherwise(state(F.concat(acc["cur"], i), acc["tok"] + t, acc["run"], no, acc["out"])))
            run = F.when(acc["last_text"], F.concat(acc["run"], i)).otherwise(i)
            seeded = let(overlap_units(acc["run"], units, overlap), lambda tail: state(
                F.concat(tail, i), total(F.transform(tail, lambda u: at(units, u)["t"])) + t,
                F.concat(tail, i), yes, emitted(acc, "text")))
            sentence = (F.when(full & (F.size(acc["cur"]) > 0), seeded)
                        .otherwise(state(F.concat(acc["cur"], i), acc["tok"] + t, run, yes, acc["out"])))
            return F.when(x["table"], table).otherwise(sentence)

        none = F.array().cast("array<struct<units:array<int>,tokens:int,kind:string>>")
        zero = state(ints(), F.lit(0), ints(), F.lit(False), none)
        steps = F.transform(units, lambda u, i: F.struct(i.alias("i"), u["t"].alias("t"), u["table"].alias("table")))
        plan = fold(steps, zero, ["cur", "tok", "run", "last_text"], none, step, lambda acc: emitted(acc, "text"))

        def chunk(entry):
            ids = entry["units"]
            text = F.array_join(F.transform(ids, lambda u, k: F.concat(
                F.when(k == 0, "").when(at(units, u)["table"] | at(units, at(ids, k - 1))["table"], "\n\n")
                .otherwise(" "), at(units, u)["content"])), "")
            whole = F.array(F.struct(text.alias("text"), entry["tokens"].alias("token_count"),
                                     entry["kind"].alias("chunk_type")))
            return (F.when(entry["kind"] == "table_split",
                           split_large_table(at(units, at(ids, F.lit(0)))["content"], table_rows))
                    .otherwise(whole))
        return F.flatten(F.transform(plan, chunk))

    return let(_units(blocks, tokens), packed)


# ---- paragraphs and sentences with a carried tail -------------------------------------------
def _greedy(units: Column, size: int, carry: int, glue: str, kind: str, tokens) -> Column:
    """Fill chunks up to ``size``; a new chunk repeats the last ``carry`` units of a longer one."""

    def packed(counted):
        def emitted(acc):
            return F.when(F.size(acc["cur"]) == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                acc["cur"].alias("units"), acc["tok"].alias("tokens")))))

        def step(acc, x):
            i, t = ints(x["i"]), x["t"]
            kept = F.when(F.size(acc["cur"]) > carry, F.slice(acc["cur"], -carry, carry)).otherwise(ints())
            fresh = let(kept, lambda k: F.struct(
                F.concat(k, i).alias("cur"),
                (total(F.transform(k, lambda u: at(counted, u)["t"])) + t).alias("tok"), emitted(acc).alias("out")))
            return (F.when((acc["tok"] + t > size) & (F.size(acc["cur"]) > 0), fresh)
                    .otherwise(F.struct(F.concat(acc["cur"], i).alias("cur"), (acc["tok"] + t).alias("tok"),
                                        acc["out"].alias("out"))))

        none = F.array().cast("array<struct<units:array<int>,tokens:int>>")
        zero = F.struct(ints().alias("cur"), F.lit(0).alias("tok"))
        steps = F.transform(counted, lambda u, i: F.struct(i.alias("i"), u["t"].alias("t")))
        plan = fold(steps, zero, ["cur", "tok"], none, step, emitted)
        return F.transform(plan, lambda e: F.struct(
            F.array_join(F.transform(e["units"], lambda u: at(counted, u)["content"]), glue).alias("text"),
            e["tokens"].alias("token_count"), F.lit(kind).alias("chunk_type"),
            F.lit(None).cast("string").alias("table_header")))

    return let(F.zip_with(units, tokens(units), lambda u, t: F.struct(u.alias("content"), t.alias("t"))), packed)


def pack_paragraphs(content: Column, size: int = fv.SEMANTIC_CHUNK_SIZE, tokens=token_counts) -> Column:
    return _greedy(split_paragraphs(content), size, 1, "\n\n", "paragraph", tokens)


def pack_sentences_tail(content: Column, size: int = fv.SEMANTIC_CHUNK_SIZE, tokens=token_counts) -> Column:
    sentences = F.filter(F.transform(split_sentences(content), strip), lambda s: s != "")
    return _greedy(sentences, size, 2, " ", "sentence", tokens)


# ---- lines around tables -----------------------------------------------------------------------
def pack_table_lines(content: Column, size: int = fv.SEMANTIC_CHUNK_SIZE, least: int = fv.SEMANTIC_MIN_CHUNK,
                     tokens=token_counts) -> Column:
    """Tables become their own chunks; long text breaks at its last blank line with two lines of overlap."""

    def packed(rows):
        def entry(start, end, tok, kind, header):
            return F.array(F.struct(start.alias("start"), end.alias("end"), tok.alias("tokens"),
                                    F.lit(kind).alias("kind"), header.alias("header")))

        def state(start, tok, in_table, header, out):
            return F.struct(start.alias("start"), tok.alias("tok"), in_table.alias("in_table"),
                            header.alias("header"), out.alias("out"))

        def sum_of(first, n):
            return total(F.transform(F.slice(rows, first + 1, n), lambda r: r["t"]))

        none = F.lit(-1)

        def step(acc, x):
            i, t, start = x["i"], x["t"], acc["start"]
            enters = x["piped"] & ~acc["in_table"]
            flush = (i > start) & (acc["tok"] > least)
            entering = F.when(flush, state(i, t, F.lit(True), i,
                                           F.concat(acc["out"], entry(start, i, acc["tok"], "paragraph", none)))
                              ).otherwise(state(start, acc["tok"] + t, F.lit(True), i, acc["out"]))
            leaves = acc["in_table"] & ~x["piped"] & ~x["blank"]
            leaving = state(i, t, F.lit(False), none,
                            F.concat(acc["out"], entry(start, i, acc["tok"], "table", none)))
            tok = acc["tok"] + t
            grown = state(start, tok, acc["in_table"], acc["header"], acc["out"])
            breaks = F.array_max(F.filter(
                F.when(i > start, F.sequence(start + 1, i)).otherwise(ints()),
                lambda k: at(rows, k)["blank"] | at(rows, k - 1)["blank"]))
            point = F.coalesce(breaks - start, F.floor((i - start + 1) / 2).cast("int"))

            def cut(p):
                new_start = start + F.greatest(F.lit(0), p - 2)
                return F.when(p > 0, state(
                    new_start, sum_of(new_start, i - new_start + 1), F.lit(False), acc["header"],
                    F.concat(acc["out"], entry(start, start + p, sum_of(start, p), "paragraph", none)))
                ).otherwise(grown)
            return (F.when(enters, entering).when(leaves, leaving)
                    .when((tok > size) & ~acc["in_table"], let(point, cut)).otherwise(grown))

        def finish(acc):
            rest = F.struct(
                acc["start"].alias("start"), F.size(rows).alias("end"), acc["tok"].alias("tokens"),
                F.when(acc["in_table"], "table").otherwise("paragraph").alias("kind"), acc["header"].alias("header"))
            return F.concat(acc["out"], F.array(rest))

        empty = F.array().cast("array<struct<start:int,end:int,tokens:int,kind:string,header:int>>")
        zero = state(F.lit(0), F.lit(0), F.lit(False), none, empty)
        steps = F.transform(rows, lambda r, i: F.struct(
            i.alias("i"), r["t"].alias("t"), r["piped"].alias("piped"), r["blank"].alias("blank")))
        plan = fold(steps, zero, ["start", "tok", "in_table", "header"], empty, step, finish)
        return F.filter(F.transform(plan, lambda e: F.struct(
            strip(F.array_join(F.transform(F.slice(rows, e["start"] + 1, e["end"] - e["start"]),
                                           lambda r: r["line"]), "\n")).alias("text"),
            e["tokens"].alias("token_count"), e["kind"].alias("chunk_type"),
            F.when(e["header"] >= 0, strip(at(rows, e["header"])["line"])).alias("table_header"))),
            lambda c: c["text"] != "")

    rows = F.zip_with(lines(content), tokens(lines(content)), lambda l, t: F.struct(
        l.alias("line"), t.alias("t"), F.contains(l, F.lit("|")).alias("piped"),
        (strip(l) == "").alias("blank")))
    return let(rows, packed)


def choose_strategy(content: Column, count: Column, size: int = fv.SEMANTIC_CHUNK_SIZE, tokens=token_counts) -> Column:
    """Whole section when its token count fits, else table lines if it has tables, else paragraphs.

    Both strategies give at least one chunk for any non-blank text, so a later
    fallback is never reached; pack_sentences_tail is there for direct use.
    """
    whole = F.array(F.struct(
        content.alias("text"), count.alias("token_count"), chunk_type(content).alias("chunk_type"),
        F.lit(None).cast("string").alias("table_header")))
    return (F.when(count <= size, whole)
            .when(contains_tables(content), pack_table_lines(content, size, tokens=tokens))
            .otherwise(pack_paragraphs(content, size, tokens)))


def chunk_semantic(sections: DataFrame, size: int = fv.SEMANTIC_CHUNK_SIZE, tokens=token_counts) -> DataFrame:
    """Chunks of already split sections, with boundary flags."""
    keep = [c for c in sections.columns if c != "content"]
    counted = sections.withColumn("_n", F.get(tokens(F.array("content")), F.lit(0)))
    chunks = (counted.select(*keep, (F.col("_n") <= size).alias("is_complete_section"), F.posexplode(
        choose_strategy(F.col("content"), F.col("_n"), size, tokens)).alias("chunk_index", "_c"))
              .select(*keep, "is_complete_section", "chunk_index", "_c.*"))
    return (chunks.withColumn("boundary_quality", F.when(F.col("is_complete_section"), "excellent")
                              .otherwise(boundary_quality("text")))
            .withColumn("is_table_content", is_table_content("text")))
