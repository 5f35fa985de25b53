"""Context, prompt and conversation text assembled from ranked results."""

from pyspark.sql import DataFrame, Window, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.text import count_tokens, file_name, title_case
from corpusq.plans.ordered import floored_sum, neighbours, top_k


def _joined(group, order, text, glue):
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(items, lambda i: i["t"]), glue)


def _source(column="source"):
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", "Unknown").otherwise(file_name(column))


def assemble_context(results: DataFrame, key: str = "question_id") -> DataFrame:
    """One context per question; results per question are bounded by the search (k and their links)."""
    header = F.concat(
        F.lit("["), title_case(F.coalesce("document_type", F.lit("unknown"))), F.lit(" | "),
        F.coalesce("edition", F.lit("unknown")), F.lit(" | "), F.coalesce("primary_section", F.lit("General")),
        F.lit(" → "), F.coalesce("subsection", F.lit("General")), F.lit(" | Source: "), _source(), F.lit("]\n"))
    if "has_metadata" in results.columns:
        header = F.when(F.col("has_metadata"), header).otherwise("[Source: Unknown]\n")
    return results.groupBy(key).agg(_joined(key, F.col("rank"), F.concat(header, F.col("text")), "\n\n---\n\n").alias("context"))


def assemble_simple_context(results: DataFrame, key: str = "question_id") -> DataFrame:
    part = F.when(F.coalesce(F.col("primary_section"), F.lit("")) != "", F.concat(
        F.lit("["), "primary_section", F.lit("] "), "text")).otherwise(F.col("text"))
    return results.groupBy(key).agg(_joined(key, F.col("rank"), part, "\n\n").alias("context"))


def assemble_context_by_section(results: DataFrame, key: str = "question_id") -> DataFrame:
    """Sections in order of first appearance, chunks in order inside, ungrouped chunks last."""
    total, index = F.coalesce("total_chunks_in_section", F.lit(1)), F.coalesce("chunk_index", F.lit(0))
    sequence = F.when(total > 1, F.concat(
        F.lit(" | Part "), (index + 1).cast("string"), F.lit("/"), total.cast("string"),
        F.when(~F.coalesce("section_complete", F.lit(True)), " (continued)").otherwise(""))).otherwise("")
    header = F.when(F.col("has_metadata"), F.concat(
        F.lit("["), title_case(F.coalesce("document_type", F.lit("unknown"))), F.lit(" | "),
        F.coalesce("edition", F.lit("unknown")), F.lit(" | "), F.coalesce("section_title", F.lit("General")), sequence,
        F.lit(" | Source: "), _source(), F.lit("]"))).otherwise("[Source: Unknown]")
    rows = results.withColumn("_part", F.concat(header, F.lit("\n"), "text"))
    sectioned = F.col("has_metadata") & F.col("section_id").isNotNull()
    inside = rows.filter(sectioned).groupBy(key, "section_id").agg(
        F.min("rank").alias("o"),
        F.array_sort(F.collect_list(F.struct(index.alias("i"), "rank", "_part", "section_title"))).alias("_c"))
    blocks = inside.select(key, F.lit(0).alias("g"), "o", F.concat(
        F.lit("## Section: "), F.coalesce(F.get("_c", F.lit(0))["section_title"], "section_id"), F.lit("\n\n"),
        F.array_join(F.transform("_c", lambda c: c["_part"]), "\n\n"), F.lit("\n\n---")).alias("t"))
    alone = rows.filter(~sectioned).select(key, F.lit(1).alias("g"), F.col("rank").alias("o"), F.col("_part").alias("t"))
    return blocks.unionByName(alone).groupBy(key).agg(
        _joined(key, F.struct("g", "o"), F.col("t"), "\n\n").alias("context"))


def answer_sources(results: DataFrame, key: str = "question_id") -> DataFrame:
    """Distinct sources in order of first appearance, and how many hits continue in a next chunk."""
    per_source = (results.filter(F.coalesce("source", F.lit("")) != "").groupBy(key, "source")
                  .agg(F.min("rank").alias("o"), F.count_if(F.coalesce("next_chunk_global", F.lit("")) != "").alias("n")))
    return per_source.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda s: s["source"]).alias("sources"),
        F.sum("n").alias("linked_chunks"))


def render_prompts(questions: DataFrame, contexts: DataFrame, templates: DataFrame, default: str = "general",
                   key: str = "question_id") -> DataFrame:
    """Fill the template of the query type (or the default one) with context, question and optional clauses.

    Templates hold the places {character_context}, {edition_context}, {context} and {question}.
    A question without a context keeps its row; its context says that nothing was found.
    """
    role, stats = F.col("character_role"), F.col("character_stats")
    clauses = F.filter(F.array(
        F.when(F.coalesce(role, F.lit("")) != "", F.concat(F.lit("Current character role: "), F.upper(F.left(role, F.lit(1))),
                                                          F.lower(F.substr(role, F.lit(2))))),
        F.when(F.coalesce(stats, F.lit("")) != "", F.concat(F.lit("Character stats: "), stats))), lambda c: c.isNotNull())
    character = F.when(F.size(clauses) > 0, F.concat(F.lit("**Character Context:** "), F.array_join(clauses, "; "))).otherwise("")
    edition = F.when(F.coalesce("edition", F.lit("")) != "", F.concat(
        F.lit("**Preferred Edition:** "), "edition", F.lit(". Default to this unless context suggests otherwise."))).otherwise("")
    history = F.when(F.coalesce("conversation_context", F.lit("")) != "", F.concat(
        F.lit("CONVERSATION HISTORY:\n"), "conversation_context", F.lit("\n\nCURRENT CONTEXT:\n"), "context")).otherwise(F.col("context"))
    fallback = templates.filter(F.col("query_type") == default).agg(F.first("template")).scalar()
    filled = F.coalesce("template", "_default")
    for place, value in (("{character_context}", character), ("{edition_context}", edition), ("{context}", F.col("_full")),
                         ("{question}", F.col("question"))):
        filled = F.replace(filled, F.lit(place), value)
    # templates are few; they meet the questions before the long texts do
    return (questions.join(F.broadcast(templates), "query_type", "left")
            .join(contexts, key, "left").withColumn("context", F.coalesce("context", F.lit(fv.NOTHING_FOUND)))
            .withColumn("_default", fallback).withColumn("_full", history)
            .select(key, filled.alias("prompt")))


def conversation_context(turns: DataFrame, n: int = fv.HISTORY_EXCHANGES, budget: int = fv.HISTORY_TOKENS,
                         last_lines: int = fv.HISTORY_LINES, key: str = "conv_id", pos: str = "turn") -> DataFrame:
    """The last n (question, answer) exchanges; over budget x 4 characters only the last lines."""
    paired = neighbours(turns, [key], pos, ["role", "text"])
    exchanges = paired.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    last = top_k(exchanges, [key], [F.col(pos).desc()], n, "_r")
    items = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("text").alias("q"), F.col("next_text").alias("a"))))
    parts = F.transform(items, lambda x, i: F.concat(
        F.lit("Previous Q"), (i + 1).cast("string"), F.lit(": "), x["q"], F.lit("\nPrevious A"), (i + 1).cast("string"),
        F.lit(": "), x["a"]))
    full = last.groupBy(key).agg(F.array_join(parts, "\n").alias("context"))
    lines = F.split("context", "\n")
    cut = F.when(F.size(lines) > last_lines, F.slice(lines, -last_lines, last_lines)).otherwise(lines)
    return full.withColumn("context", F.when(F.length("context") > budget * 4, F.array_join(cut, "\n"))
                           .otherwise(F.col("context")))


def debug_retrieval(results: DataFrame, preview: int = 200, key: str = "question_id") -> DataFrame:
    """Per hit: index, labels, word count, preview and the number of hits of its question."""
    counts = results.groupBy(key).agg(F.count(F.lit(1)).alias("chunks_count"))
    return results.join(counts, key).select(
        key, (F.col("rank") - 1).alias("chunk_index_in_results"), F.coalesce("primary_section", F.lit("Unknown")).alias("classification"),
        F.coalesce("content_type", F.lit("unknown")).alias("content_type"), F.coalesce("contains_rules", F.lit(False)).alias("contains_rules"),
        count_tokens("text").alias("word_count"),
        F.when(F.length("text") > preview, F.concat(F.left("text", F.lit(preview)), F.lit("..."))).otherwise(F.col("text")).alias("preview"),
        "chunks_count")


# ---- reasoning tags -----------------------------------------------------------------------
OPEN_TAG, CLOSE_TAG = "<think>", "</think>"
#: Tokens that are joined at once; the joined runs of a message are joined again, so this does not show in the result.
TOKENS_PER_PART = 100000


def reasoning_tokens(tokens: DataFrame, key: str = "conv_id", pos: str = "seq", token: str = "token",
                     open_tag: str = OPEN_TAG, close_tag: str = CLOSE_TAG) -> DataFrame:
    """(key, pos, inside, token) of tokenised messages without the tags; a tag is a token of its own.

    A closing tag outside thinking is ignored: depth never falls below zero.
    The scan is cut into position ranges and nothing is gathered, so one
    endless stream is no hot task.
    """
    step = F.when(F.col(token) == open_tag, 1).when(F.col(token) == close_tag, -1).otherwise(0)
    deep = floored_sum(tokens.withColumn("_step", step), [key], pos, "_step", "_depth")
    return deep.filter(F.col("_step") == 0).select(key, pos, (F.col("_depth") > 0).alias("inside"), token)


def split_reasoning(tokens: DataFrame, key: str = "conv_id", pos: str = "seq", token: str = "token",
                    open_tag: str = OPEN_TAG, close_tag: str = CLOSE_TAG, part: int = TOKENS_PER_PART) -> DataFrame:
    """(key, part, thinking, answer), one row per message of any length; part is always 0.

    Ranges of ``part`` positions are joined first and then their texts, in order.
    """
    rows = reasoning_tokens(tokens, key, pos, token, open_tag, close_tag).withColumn("_run", F.floor(F.col(pos) / F.lit(part)))
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("inside"), F.col(token).alias("t"))))

    def text(inside):
        return F.array_join(F.transform(F.filter("_i", lambda i: i["inside"] == inside), lambda i: i["t"]), "")
    runs = (rows.groupBy(key, "_run").agg(items.alias("_i"))
            .select(key, "_run", text(True).alias("thinking"), text(False).alias("answer")))
    joined = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_run", "thinking", "answer"))).alias("_r"))
    return joined.select(key, F.lit(0).cast("long").alias("part"), *[
        F.array_join(F.col("_r")[c], "").alias(c) for c in ("thinking", "answer")])


def tag_tokens(messages: DataFrame, keys: list[str], text: str = "text", open_tag: str = OPEN_TAG,
               close_tag: str = CLOSE_TAG) -> DataFrame:
    """Cut message text into tags and the text between them: (keys, seq, token)."""
    around = f"(?={open_tag}|{close_tag})|(?<={open_tag}|{close_tag})"
    pieces = F.filter(F.split(F.col(text), around), lambda t: t != "")
    return messages.select(*keys, F.posexplode(pieces).alias("seq", "token"))
