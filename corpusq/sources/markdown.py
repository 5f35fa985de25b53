"""Markdown document source and sink, with front matter."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusq.functions.text import classify_title, lines, safe_file_name, strip


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Every *.md below the path, one row per file with its whole text."""
    return (spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
            .select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"),
                    F.md5("value").alias("hash"), F.col("_metadata.file_size").alias("file_size")))


def front_matter(text: Column) -> Column:
    """MAP of the ``key: "value"`` lines between the leading --- and the next one."""
    block = F.regexp_extract(text, r"(?s)^---(.*?)---", 1)

    def pair(line):
        value = strip(F.regexp_replace(line, r"^[^:]*:", ""))
        return F.struct(strip(F.substring_index(line, ":", 1)).alias("k"),
                        F.regexp_replace(value, r'^"|"$', "").alias("v"))

    pairs = F.transform(F.filter(lines(block), lambda l: F.contains(l, F.lit(":"))), pair)
    keys = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)


def parse_front_matter(docs: DataFrame, text: str = "text") -> DataFrame:
    has = F.rlike(text, F.lit(r"(?s)^---.*?---"))
    return (docs.withColumn("meta", F.when(has, front_matter(F.col(text))))
            .withColumn("body", F.when(has, F.regexp_replace(text, r"(?s)^---.*?---\s*", "")).otherwise(F.col(text))))


def render_front_matter(title, source, number, content, edition: str = "sr5", document_type: str = "rulebook",
                        method: str = "toc_guided") -> Column:
    quoted = [("title", title), ("source", source)]
    tail = [("primary_section", classify_title(title)), ("extraction_method", F.lit(method)),
            ("edition", F.lit(edition)), ("document_type", F.lit(document_type))]

    def line(name, value):
        return F.concat(F.lit(f'{name}: "'), value, F.lit('"\n'))
    return F.concat(
        F.lit("---\n"), *[line(n, v) for n, v in quoted],
        F.lit("section_number: "), number.cast("string"), F.lit("\n"),
        *[line(n, v) for n, v in tail], F.lit("---\n\n# "), title, F.lit("\n\n"), content)


def write_front_matter(sections: DataFrame, **fixed) -> DataFrame:
    """(file_name, text) of each section row (source, section_number, title, content)."""
    stem = F.regexp_replace("source", r"(?<=.)\.[^.]*$", "")
    return sections.select(
        safe_file_name(stem, F.col("section_number"), F.col("title")).alias("file_name"),
        render_front_matter(F.col("title"), F.col("source"), F.col("section_number"), F.col("content"),
                            **fixed).alias("text"))


def save_documents(documents: DataFrame, path: str, partition_by: str = "source") -> None:
    """Store documents as Parquet by source; one directory per source, rewritten dynamically."""
    (documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_by).parquet(path))
