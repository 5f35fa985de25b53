"""Corpus statistics.  Every report is one combining aggregation over the chunks."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusq.functions import fixed_values as fv, quality as Q
from corpusq.functions.text import _col, any_term, count_tokens
from corpusq.plans.ordered import top_k
from corpusq.plans.scratch import shared_folder


def size_stats(chunks: DataFrame, text: str = "text", group: list[str] = ()) -> DataFrame:
    """min / max / mean / median / sample deviation of words, the first four of characters.

    The medians are exact; their state is one counter per distinct length.
    """
    words, chars = count_tokens(text), F.length(text)
    sized = chunks.select(*group, words.alias("_w"), chars.alias("_c"))
    return sized.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.min("_w").alias("word_min"), F.max("_w").alias("word_max"), F.avg("_w").alias("word_mean"),
        F.median("_w").alias("word_median"), F.coalesce(F.stddev_samp("_w"), F.lit(0.0)).alias("word_std_dev"),
        F.min("_c").alias("char_min"), F.max("_c").alias("char_max"), F.avg("_c").alias("char_mean"),
        F.median("_c").alias("char_median"))


def size_histogram(chunks: DataFrame, text: str = "text", bins=None) -> DataFrame:
    """(bin, n) for every bin, empty ones included."""
    bins = bins or fv.SIZE_BINS
    words = F.col("_w")
    counts = chunks.select(count_tokens(text).alias("_w")).agg(*[
        F.count_if((words >= low) & (F.lit(True) if high is None else words < high)).alias(f"b{i}")
        for i, (_, low, high) in enumerate(bins)])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("bin_ord"), F.lit(name).alias("bin"), F.col(f"b{i}").alias("n"))
        for i, (name, _, _) in enumerate(bins)])).alias("_b")).select("_b.*")


def value_counts(chunks: DataFrame, columns: list[str], missing: str = "Unknown") -> DataFrame:
    """(field, value, n) of every column in one pass over grouping sets."""
    filled = chunks.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns])
    sets = filled.groupingSets([[filled[c]] for c in columns], *[filled[c] for c in columns])
    counted = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*columns).alias("_g"))
    full = (1 << len(columns)) - 1
    field, value = F, F
    for i, c in enumerate(columns):
        own = full ^ (1 << (len(columns) - 1 - i))
        field = field.when(F.col("_g") == own, F.lit(c))
        value = value.when(F.col("_g") == own, F.col(c))
    return counted.select(field.alias("field"), value.alias("value"), "n")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dominance(chunks: DataFrame, column: str, top: int = 3, missing: str = "Unknown") -> DataFrame:
    """The most common values with their joint share, and the diversity of the column.

    The chunks are read once; the counts of the distinct values are stored and read twice.
    """
    counts = _stored(chunks.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(
        F.count(F.lit(1)).alias("n")), "value-counts")
    first = counts.orderBy(F.col("n").desc(), "value").limit(top)
    share = first.agg(F.sum("n").alias("in_top"), F.array_sort(F.collect_list(F.struct(
        (-F.col("n")).alias("o"), "value", "n"))).alias("_t"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_values"))
    total, distinct = F.col("total"), F.col("unique_values")
    in_top = F.col("in_top")
    return (totals.withColumn("in_top", share.select("in_top").scalar())
            .withColumn("top_values", share.select(F.transform("_t", lambda t: F.struct(t["value"], t["n"]))).scalar())
            .select("top_values", F.bround(in_top / total * 100, 1).alias("top_percentage"), "unique_values",
                    F.bround(distinct / total * 100, 1).alias("diversity")))


QUALITY_FLAGS = {
    "empty_chunk": Q.is_empty_chunk, "header_only": Q.is_header_only, "incomplete_sentence": Q.has_incomplete_sentence,
    "orphaned_header": Q.is_orphan_header, "missing_context": Q.is_missing_context,
    "split_mid_sentence": Q.splits_mid_sentence, "split_mid_table": Q.splits_mid_table,
}


def quality_flags(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumns({name: test(text) for name, test in QUALITY_FLAGS.items()})


def quality_counts(chunks: DataFrame, text: str = "text") -> DataFrame:
    return quality_flags(chunks, text).agg(*[F.count_if(name).alias(name) for name in QUALITY_FLAGS])


def example_vs_rule(chunks: DataFrame, text: str = "text") -> DataFrame:
    kinds = ["examples_only", "rules_only", "unclear_or_mixed"]
    counted = chunks.select(Q.example_or_rule(text).alias("_k")).agg(
        *[F.count_if(F.col("_k") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("_n"))
    return counted.select(*kinds, F.bround(F.col("examples_only") / F.col("_n") * 100, 1).alias("example_percentage"))


def cross_reference_issues(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.agg(F.count_if(Q.has_cross_reference_issue(text)).alias("cross_reference_issues"))


def topic_rows(chunks: DataFrame, text: str = "text", words=None, pair_words=None, markers=None) -> DataFrame:
    """Chunks about a topic: a topic word, or a pair word together with a marker."""
    low = F.lower(_col(text))
    about = any_term(low, words or fv.TOPIC_WORDS) | (
        any_term(low, pair_words or fv.TOPIC_PAIR_WORDS) & any_term(low, markers or fv.TOPIC_PAIR_MARKERS))
    return (chunks.filter(about)
            .withColumn("has_explicit_rule", F.contains(low, F.lit("dice pool")) & F.contains(low, F.lit("resist")))
            .withColumn("is_example", any_term(low, ["example", "e.g.", "for instance"])))


def topic_slice(chunks: DataFrame, key: str, text: str = "text", label: str = "primary_section", **words) -> DataFrame:
    """Totals of the topic, class distribution as (class, n) rows in a map, previews of the first three."""
    rows = topic_rows(chunks, text, **words)
    previews = rows.orderBy(key).limit(3).agg(F.transform(F.array_sort(F.collect_list(F.struct(key, F.when(
        F.length(text) > 200, F.concat(F.left(text, F.lit(200)), F.lit("..."))).otherwise(F.col(text)).alias("p")))),
        lambda p: p["p"]).alias("v"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_relevant_chunks"),
        F.count_if("has_explicit_rule").alias("chunks_with_explicit_rules"),
        F.count_if(F.col("is_example") & ~F.col("has_explicit_rule")).alias("chunks_with_examples_only"),
    ).withColumn("sample_previews", previews.scalar())


def topic_classes(chunks: DataFrame, text: str = "text", label: str = "primary_section", **words) -> DataFrame:
    return topic_rows(chunks, text, **words).groupBy(F.coalesce(label, F.lit("Unknown")).alias("classification")).agg(
        F.count(F.lit(1)).alias("n"))


def recommendations(stats: DataFrame) -> DataFrame:
    """Texts of the rules that hold for a statistics row, in order.

    Columns: word_std_dev, word_mean, top_percentage, examples_only, rules_only,
    split_mid_sentence, total_chunks, topic_examples, topic_rules, poor_boundaries.
    """
    text = fv.RECOMMENDATIONS
    poor = F.col("poor_boundaries") / F.col("total_chunks") * 100
    rules = F.array(
        F.when(F.col("word_std_dev") > F.col("word_mean") * 0.8, text["uneven_sizes"]),
        F.when(F.col("top_percentage") > 80, text["concentrated_classes"]),
        F.when(F.col("examples_only") > F.col("rules_only"), text["too_many_examples"]),
        F.when(F.col("split_mid_sentence") > F.col("total_chunks") * 0.1, text["mid_sentence"]),
        F.when(F.col("topic_examples") > F.col("topic_rules"), text["topic_examples"]),
        F.when(poor > 20, text["boundary_high"]).when(poor > 10, text["boundary_medium"]).otherwise(text["boundary_good"]))
    return stats.withColumn("recommendations", F.filter(rules, lambda r: r.isNotNull()))


def chunk_statistics(chunks: DataFrame, group: list[str] = ()) -> DataFrame:
    """Token, boundary and type totals of annotated chunks."""
    quality = F.col("boundary_quality")
    e, g, p, n = (F.count_if(quality == "excellent"), F.count_if(quality == "good"), F.count_if(quality == "poor"),
                  F.count(F.lit(1)))
    return chunks.groupBy(*group).agg(
        n.alias("total_chunks"), F.min("token_count").alias("token_min"), F.max("token_count").alias("token_max"),
        F.avg("token_count").alias("token_avg"), e.alias("excellent"), g.alias("good"), p.alias("poor"),
        ((e * 3 + g * 2 + p) / (n * 3) * 100).alias("quality_score"),
        F.count_if("is_table_content").alias("table_chunks"),
        F.count_if(F.col("starts_mid_sentence") | F.col("ends_mid_sentence")).alias("poor_boundary_chunks"))


#: Stands for a missing path among the counted values.
NO_PATH = "\x00"


def collection_stats(chunks: DataFrame, key: str, sample: int | None = None, path: str = "doc_path") -> DataFrame:
    """Totals and distributions over everything; on request, distributions over the first ``sample`` rows by key.

    The chunks are read once, for the counts of all fields and of the paths
    (twice with a sample); all figures come from these counts.
    """
    fields = ["primary_section", "content_type", "chunk_type"]
    named = chunks.withColumn(path, F.coalesce(path, F.lit(NO_PATH)))
    if sample:
        rows = value_counts(named.orderBy(key).limit(sample), [*fields, "is_table_content"]).unionByName(value_counts(named, [path]))
    else:
        rows = value_counts(named, [*fields, "is_table_content", path])
    field, n = F.col("field"), F.col("n")

    def spread(name):
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(field == name, F.struct("value", "n")))))
    return _stored(rows, "collection").agg(
        F.coalesce(F.sum(F.when(field == path, n)), F.lit(0)).alias("total_chunks"),
        F.count_if((field == path) & (F.col("value") != NO_PATH)).alias("indexed_files"),
        spread("primary_section").alias("section_distribution"), spread("content_type").alias("content_type_distribution"),
        spread("chunk_type").alias("chunk_type_distribution"),
        F.coalesce(F.sum(F.when((field == "is_table_content") & (F.col("value") == "true"), n)), F.lit(0)).alias("table_chunks"),
        F.coalesce(F.sum(F.when(field == fields[0], n)), F.lit(0)).alias("sample_size"))


def quality_report(chunks: DataFrame, key: str, sample: int | None = None) -> DataFrame:
    """Shares and token figures over all chunks; on request, over the first ``sample`` rows by key."""
    scope = chunks.orderBy(key).limit(sample) if sample else chunks
    table, mixed, entity = F.col("is_table_content"), F.col("chunk_type") == "mixed", F.col("has_entities")
    n = F.count(F.lit(1))
    return scope.agg(
        n.alias("sample_size"), F.count_if(table).alias("table_chunks"), F.count_if(~table & ~mixed).alias("text_chunks"),
        F.count_if(~table & mixed).alias("mixed_chunks"), F.count_if(entity).alias("entity_chunks"),
        F.avg("token_count").alias("average_tokens"), F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"), (F.count_if(table) / n * 100).alias("table_preservation_score"),
        (F.count_if(entity) / n * 100).alias("entity_extraction_rate"))


def document_stats(chunks: DataFrame, source: str = "source", job_count: Column | None = None) -> DataFrame:
    """Long form (category, count): documents, chunks, active jobs, types, editions and sections."""
    totals = chunks.agg(F.count_distinct(source).alias("d"), F.count(F.lit(1)).alias("c"))
    heads = totals.select(F.explode(F.array(
        F.struct(F.lit("Documents").alias("category"), F.col("d").alias("count")),
        F.struct(F.lit("Text Chunks").alias("category"), F.col("c").alias("count")),
        F.struct(F.lit("Active Jobs").alias("category"), (job_count if job_count is not None else F.lit(0)).cast("long").alias("count"))
    )).alias("_r")).select("_r.*")
    names = {"document_type": "Type: ", "edition": "Edition: ", "primary_section": "Section: "}
    prefix = reduce(lambda c, i: c.when(F.col("field") == i[0], F.lit(i[1])), names.items(), F)
    parts = value_counts(chunks, list(names), "unknown").select(
        F.concat(prefix, "value").alias("category"), F.col("n").alias("count"))
    return heads.unionByName(parts)


def keyword_counts(chunks: DataFrame, groups=None, text: str = "text", top: int = 10) -> DataFrame:
    """(group_name, keyword, n, rank): chunks per keyword, the ten most frequent of each group."""
    groups = groups or fv.KEYWORD_GROUPS
    low = F.col("_low")
    flat = [(g, k) for g, ks in groups for k in ks]
    one = chunks.select(F.lower(_col(text)).alias("_low")).agg(
        *[F.count_if(F.contains(low, F.lit(k))).alias(f"k{i}") for i, (_, k) in enumerate(flat)])
    rows = one.select(F.explode(F.array(*[F.struct(
        F.lit(g).alias("group_name"), F.lit(k).alias("keyword"), F.lit(i).alias("ord"), F.col(f"k{i}").alias("n"))
        for i, (g, k) in enumerate(flat)])).alias("_k")).select("_k.*").filter("n > 0")
    window = Window.partitionBy("group_name").orderBy(F.col("n").desc(), "ord")
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top).drop("ord")


def structure_counts(chunks: DataFrame, text: str = "text", phrase: str = "dice pool", word: str = "test") -> DataFrame:
    col = _col(text)
    low = F.lower(col)
    return chunks.agg(
        F.count_if(Q.occurrences(col, "|") > 5).alias("with_tables"),
        F.count_if(F.rlike(col, F.lit("(?m)^#+"))).alias("with_headers"),
        F.count_if(F.contains(col, F.lit("[")) & F.contains(col, F.lit("]("))).alias("with_links"),
        F.count_if(F.contains(low, F.lit(phrase))).alias("with_phrase"),
        F.count_if(F.rlike(low, F.lit(rf"(?U)\b{word}\b"))).alias("with_word"))


def first_match_sample(chunks: DataFrame, topics: dict, key: str, text: str = "text", chars: int = 500) -> DataFrame:
    """(topic, key, sample): the first chunk with any of the topic's words."""
    low = F.lower(_col(text))
    hit = F.struct(F.col(key), F.left(text, F.lit(chars)).alias("sample"))
    firsts = chunks.agg(*[F.min_by(hit, F.when(any_term(low, words), F.col(key))).alias(f"t{i}")
                          for i, words in enumerate(topics.values())])
    return firsts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("topic"), F.col(f"t{i}").alias("m")) for i, name in enumerate(topics)])).alias("_t")).select(
        "_t.topic", f"_t.m.{key}", "_t.m.sample").filter(F.col(key).isNotNull())


def label_diversity(chunks: DataFrame, label: str = "primary_section", sections: str = "sections",
                    keywords: str = "mechanical_keywords", words=("taser", "stun", "electrical")) -> DataFrame:
    n = F.count(F.lit(1))
    distinct = F.count_distinct(F.coalesce(label, F.lit("Unknown")))
    multi = F.count_if(F.size(F.split(F.coalesce(sections, F.lit("")), ",")) > 1)
    hits = F.count_if(any_term(F.lower(F.coalesce(keywords, F.lit(""))), words))
    return (chunks.agg(n.alias("total"), distinct.alias("classes"), multi.alias("multi_label"), hits.alias("keyword_hits"))
            .withColumn("diversity", F.bround(F.col("classes") / F.col("total") * 100, 1))
            .withColumn("diverse", F.col("classes") > 3)
            .withColumn("multi_labelled", F.col("multi_label") > F.col("total") * 0.2))


def profile_metadata(df: DataFrame, key: str, examples: int = 10, expected=None) -> tuple[DataFrame, DataFrame]:
    """((field, examples): the smallest values of every field filled anywhere, (field): expected ones that are filled nowhere)."""
    fields = [c for c in df.columns if c != key]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])).alias("_f")).select("_f.*")
    values = long.filter(F.col("value").isNotNull()).distinct()
    present = (top_k(values, ["field"], [F.col("value")], examples).groupBy("field")
               .agg(F.array_sort(F.collect_list("value")).alias("examples")))
    wanted = df.sparkSession.createDataFrame([(f,) for f in (expected or fv.EXPECTED_FIELDS)], "field string")
    return present, wanted.join(present.select("field"), "field", "left_anti")


def embedding_profile(chunks: DataFrame, vec: str = "embedding", key: str = "chunk_id") -> DataFrame:
    return chunks.agg(F.max(F.size(vec)).alias("embedding_dimension"), F.count(F.lit(1)).alias("document_count"),
                      F.min(key).alias("sample_id"))
