"""Chunk assembly, identifiers and links."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.arrays import at, let
from corpusq.functions.quality import boundary_quality, ends_mid_sentence, is_table_content, starts_mid_sentence
from corpusq.functions.text import clean_text, file_stem
from corpusq.operators.packing import pack_sentences, token_counts
from corpusq.operators.sections import HEADER_LINE, content_blocks, header_sections, table_ranges
from corpusq.plans.nesting import salted_join
from corpusq.plans.once import compute_once
from corpusq.plans.ordered import neighbours, top_k

# one section spans this many positions in the document-wide chunk order: more than a chunk index, an INT, can count
SECTION_SPAN = 1 << 32


def chunk_id(path, section_index, chunk_index) -> Column:
    return F.concat_ws("_", file_stem(path), F.lit("section"), section_index, F.lit("chunk"), chunk_index)


def content_chunk_id(path, chunk_index, text) -> Column:
    return F.concat_ws("_", file_stem(path), chunk_index, F.left(F.md5(text), F.lit(8)))


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned text with the number of characters removed; documents left empty are dropped."""
    cleaned = compute_once(docs.withColumn("_chars", F.length(text)), text, clean_text(text))
    return (cleaned.withColumn("chars_removed", F.col("_chars") - F.length(text)).drop("_chars")
            .filter(F.col(text) != ""))


def chunk_documents(docs: DataFrame, path: str = "doc_path", text: str = "text", size: int = fv.CHUNK_SIZE,
                    overlap: int = fv.CHUNK_OVERLAP, header: str = HEADER_LINE, tokens=token_counts,
                    siblings: int = 5) -> DataFrame:
    """Cleaned documents to linked chunks: sections, blocks, packing, ids and links in one narrow stage.

    All chunks of a document come out of its own row, so their links are array
    positions and nothing is shuffled.  A registered tokenizer cannot run inside
    that row; with one, sections are exploded first and linked by a window.
    """
    if tokens is not token_counts:
        return _chunk_sections(docs, path, text, size, overlap, header, tokens, siblings)
    keep = [c for c in docs.columns if c != text]

    def of_section(section, number, kind):
        packed = pack_sentences(content_blocks(section["content"], kind), size, overlap)
        return let(packed, lambda chunks: F.transform(chunks, lambda c, i: F.struct(
            number.alias("section_index"), section["title"].alias("section_title"), section["level"].alias("section_level"),
            i.alias("chunk_index"), F.size(chunks).alias("total_chunks_in_section"), c["text"].alias("text"),
            c["token_count"].alias("token_count"), c["chunk_type"].alias("chunk_type"))))

    def of_document(body):
        kind = at(table_ranges(body), F.lit(0))["table_type"]
        return let(kind, lambda k: F.flatten(F.transform(header_sections(body, header), lambda s, i: of_section(s, i, k))))

    def linked(all_, stem, c, i):
        def identifier(section, index):
            return F.concat_ws("_", stem, F.lit("section"), section, F.lit("chunk"), index)
        before, after = at(all_, i - 1), at(all_, i + 1)
        section, index, total = c["section_index"], c["chunk_index"], c["total_chunks_in_section"]
        others = F.filter(F.sequence(F.lit(0), F.least(total - 1, F.lit(siblings))), lambda x: x != index)
        return F.struct(
            c.alias("c"), F.when(before.isNotNull(), identifier(before["section_index"], before["chunk_index"])).alias("prev"),
            F.when(after.isNotNull(), identifier(after["section_index"], after["chunk_index"])).alias("next"),
            F.transform(F.slice(others, 1, siblings), lambda x: identifier(section, x)).alias("siblings"))

    rows = compute_once(docs, "_all", of_document(F.col(text))).select(*keep, F.explode(
        let(file_stem(path), lambda stem: F.transform("_all", lambda c, i: linked(F.col("_all"), stem, c, i)))).alias("_l"))
    section, index = F.col("section_index"), F.col("chunk_index")
    out = rows.select(*keep, "_l.c.*", F.col("_l.prev").alias("prev_chunk_global"), F.col("_l.next").alias("next_chunk_global"),
                      F.col("_l.siblings").alias("section_chunk_ids"))
    last = F.col("total_chunks_in_section") - 1
    return _identified(out, path).withColumns({
        "prev_chunk_section": F.when(index > 0, F.col("prev_chunk_global")),
        "next_chunk_section": F.when(index < last, F.col("next_chunk_global")),
        "section_complete": index == last,
        "section_id": F.concat_ws("_", file_stem(path), F.lit("section"), section)})


def _identified(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.withColumns({
        "chunk_id": chunk_id(path, F.col("section_index"), F.col("chunk_index")),
        "chunk_pos": F.col("section_index").cast("long") * SECTION_SPAN + F.col("chunk_index"),
        "char_count": F.length("text"),
        "is_table_content": F.col("chunk_type").isin("table", "table_split")})


def _chunk_sections(docs, path, text, size, overlap, header, tokens, siblings) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    named = compute_once(docs, "_table_type", at(table_ranges(F.col(text)), F.lit(0))["table_type"])
    sections = (named.select(*keep, "_table_type",
                             F.posexplode(header_sections(F.col(text), header)).alias("section_index", "_s"))
                .select(*keep, "_table_type", "section_index", F.col("_s.title").alias("section_title"),
                        F.col("_s.level").alias("section_level"), F.col("_s.content").alias("_content")))
    packed = pack_sentences(content_blocks(F.col("_content"), F.col("_table_type")), size, overlap, tokens=tokens)
    fields = ["section_index", "section_title", "section_level", "chunk_index"]
    chunks = (sections.select(*keep, *fields[:3], F.posexplode(packed).alias("chunk_index", "_c"))
              .select(*keep, *fields, "_c.*"))
    recount = F.get(tokens(F.array("text")), F.lit(0))
    chunks = chunks.withColumn("token_count", F.when(F.col("chunk_type") == "table_split", recount).otherwise(F.col("token_count")))
    return link_siblings(link_sequential(_identified(chunks, path), path), path, k=siblings)


def annotate_quality(chunks: DataFrame, text: str = "text") -> DataFrame:
    return (chunks.withColumn("boundary_quality", boundary_quality(text))
            .withColumn("starts_mid_sentence", starts_mid_sentence(text))
            .withColumn("ends_mid_sentence", ends_mid_sentence(text))
            .withColumn("looks_like_table", is_table_content(text)))


def link_sequential(chunks: DataFrame, doc: str = "doc_path", pos: str = "chunk_pos", chunk: str = "chunk_id",
                    section: str | None = "section_index") -> DataFrame:
    """prev/next chunk in the document and, when a section column is given, within the section.

    Windows and counts run over ids and positions only; a chunk's text moves
    once, to meet its links by document and position (null-safe, so no row is lost).
    """
    values = [chunk] + ([section] if section else [])
    links = neighbours(chunks.select(doc, pos, *values), [doc], pos, values)
    links = (links.withColumnRenamed(f"prev_{chunk}", "prev_chunk_global")
             .withColumnRenamed(f"next_{chunk}", "next_chunk_global"))
    if section:
        totals = chunks.groupBy(doc, section).agg(F.count(F.lit(1)).cast("int").alias("total_chunks_in_section"))
        links = salted_join(links, totals, [doc, section], chunk, counted=chunks)
        same_prev = F.col(f"prev_{section}") == F.col(section)
        same_next = F.col(f"next_{section}") == F.col(section)
        links = (links.withColumn("prev_chunk_section", F.when(same_prev, F.col("prev_chunk_global")))
                 .withColumn("next_chunk_section", F.when(same_next, F.col("next_chunk_global")))
                 .withColumn("section_complete", F.col("next_chunk_section").isNull())
                 .withColumn("section_id", F.concat_ws("_", file_stem(F.col(doc).cast("string")), F.lit("section"), section))
                 .drop(f"prev_{section}", f"next_{section}"))
    links = links.drop(*values).withColumnsRenamed({doc: "_doc", pos: "_pos"})
    return chunks.join(links, chunks[doc].eqNullSafe(links["_doc"]) & chunks[pos].eqNullSafe(links["_pos"])).drop("_doc", "_pos")


def _link_group(chunks: DataFrame, keys: list[str], pos: str, chunk: str, k: int, out: str) -> DataFrame:
    """First k other ids of the group.  Only k + 1 ids per group are ever gathered."""
    heads = (top_k(chunks.select(*keys, pos, chunk), keys, [F.col(pos)], k + 1)
             .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, chunk))).alias("_heads")))
    others = F.transform(F.filter("_heads", lambda h: h[chunk] != F.col(chunk)), lambda h: h[chunk])
    return salted_join(chunks, heads, keys, chunk).withColumn(out, F.slice(others, 1, k)).drop("_heads")


def link_siblings(chunks: DataFrame, doc: str = "doc_path", section: str = "section_index", pos: str = "chunk_pos",
                  chunk: str = "chunk_id", k: int = 5) -> DataFrame:
    return _link_group(chunks, [doc, section], pos, chunk, k, "section_chunk_ids")


def link_table_continuations(chunks: DataFrame, doc: str = "doc_path", header: str = "table_header",
                             pos: str = "chunk_pos", chunk: str = "chunk_id", k: int = 3) -> DataFrame:
    """For table chunks, the first k other chunks with the same header; a missing header matches a missing one."""
    keyed = (chunks.withColumn("_has_header", F.col(header).isNotNull())
             .withColumn("_header", F.coalesce(F.col(header), F.lit(""))))
    linked = _link_group(keyed, [doc, "_has_header", "_header"], pos, chunk, k, "_linked")
    return (linked.withColumn("table_continuation_ids",
                              F.when(F.col("is_table_content"), F.col("_linked")))
            .drop("_has_header", "_header", "_linked"))
