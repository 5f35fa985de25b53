"""Pluggable callables: tokenizer, embedder, labeller, and SQL table functions."""

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType

from corpusq.functions import fixed_values as fv
from corpusq.plans.batches import bound_batches


def register_tokenizer(fn: Callable[[str], int]) -> Callable[[Column], Column]:
    """A token counter for the packing operators: ARRAY<STRING> -> ARRAY<INT> in Arrow batches."""
    bound_batches()

    @F.pandas_udf(ArrayType(IntegerType()))
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda items: [fn(t) for t in items])
    return lambda texts: counted(texts)


def register_embedder(load: Callable[[], Callable[[list[str]], list]], dim: int) -> Callable[[Column], Column]:
    """``load`` builds the model once per task.

    A batch that fails is tried again text by text.  A text that fails alone, or gets
    something else than ``dim`` numbers, ends the job with an error: no vector stands for a failure.
    """
    bound_batches()

    @F.pandas_udf(ArrayType(FloatType()))
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            asked = texts.fillna("").tolist()
            try:
                made = _vectors(model, asked, dim)
            except Exception:
                made = [_one(model, t, dim) for t in asked]
            yield pd.Series(made)
    return lambda texts: embedded(texts)


def _vectors(model, texts, dim):
    made = list(model(texts))
    if len(made) != len(texts) or any(len(v) != dim for v in made):
        raise ValueError(f"the model has to give one vector of {dim} numbers per text")
    return made


def _one(model, text, dim):
    try:
        return list(_vectors(model, [text], dim)[0])
    except Exception as e:
        raise RuntimeError(f"no vector for the text that begins with {text[:60]!r}: {e}") from e


def register_labeller(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """Raw label JSON per text, to be read by parse_label_responses; a failing text gives NULL."""
    bound_batches()

    @F.pandas_udf(StringType())
    def labelled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _quiet(fn, t))
    return lambda texts: labelled(texts)


def _quiet(fn, text):
    try:
        return fn(text)
    except Exception:
        return None


def label_and_correct(chunks: DataFrame, labeller: Callable[[Column], Column], text: str = "text",
                      cut: int | None = None) -> DataFrame:
    """Labels of a model where valid (then pattern-corrected), pattern labels elsewhere.

    The model gets the whole text; ``cut`` limits it to so many characters.
    """
    from corpusq.operators.labelling import correct_labels, parse_label_responses
    raw = chunks.withColumn("_raw", labeller(F.col(text) if cut is None else F.left(F.col(text), F.lit(cut))))
    parsed = parse_label_responses(raw, "_raw", text)
    corrected = correct_labels(parsed.withColumn("_p", F.col("primary_section")).withColumn("_t", F.col("content_type")), text)
    modelled = F.col("classification_method") == "llm_semantic"
    return (corrected.withColumn("primary_section", F.when(modelled, F.col("primary_section")).otherwise(F.col("_p")))
            .withColumn("content_type", F.when(modelled, F.col("content_type")).otherwise(F.col("_t")))
            .drop("_p", "_t", "_raw"))


# ---- SQL table functions --------------------------------------------------------------
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
CHUNK_TYPE = "array<struct<chunk_index:int,text:string,token_count:int>>"
RECORD_TYPE = "array<struct<record_no:int,name:string,details:map<string,string>>>"
RECORD_FIELDS = {
    "spell": (fv.SPELL_RECORD, re.IGNORECASE, ["name", "spell_type", "range", "damage", "duration", "drain"]),
    "ic": (fv.IC_RECORD, 0, ["name", "attack_pattern", "resistance_test"]),
}


def unit_cuts(tokens: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each chunk of a run of units, from the prefix sums of their tokens.

    A chunk takes units while they fit ``size``, one at least; the next one
    begins with the longest tail of it that fits ``overlap``.
    """
    upto = np.concatenate([[0], np.cumsum(tokens)])
    cuts, start, fresh = [], 0, 0
    while fresh < len(tokens):
        end = max(int(np.searchsorted(upto, upto[start] + size, side="right")) - 1, fresh + 1)
        cuts.append((start, end))
        start, fresh = max(start, int(np.searchsorted(upto, upto[end] - overlap, side="left"))), end
    return cuts


def _chunks(text: str, size: int, overlap: int) -> list[dict]:
    units = [s for s in SENTENCE_END.split((text or "").strip()) if s]
    tokens = np.array([len(s.split()) for s in units], dtype=np.int64)
    return [{"chunk_index": i, "text": " ".join(units[a:b]), "token_count": int(tokens[a:b].sum())}
            for i, (a, b) in enumerate(unit_cuts(tokens, size, overlap))]


def _records(text: str, kind: str) -> list[dict]:
    pattern, flags, fields = RECORD_FIELDS[kind]
    found = []
    for number, match in enumerate(re.finditer(pattern, text or "", flags)):
        values = {f: (match.group(i + 1) or "").strip() for i, f in enumerate(fields)}
        found.append({"record_no": number, "name": values.pop("name"), "details": list(values.items())})
    return found


def _chunk_batches(texts: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
    made = [_chunks(*row) for row in zip(texts.to_pylist(), sizes.to_pylist(), overlaps.to_pylist())]
    return pa.array(made, pa.list_(pa.struct([("chunk_index", pa.int32()), ("text", pa.string()), ("token_count", pa.int32())])))


def _record_batches(texts: pa.Array, kinds: pa.Array) -> pa.Array:
    made = [_records(*row) for row in zip(texts.to_pylist(), kinds.to_pylist())]
    return pa.array(made, pa.list_(pa.struct([("record_no", pa.int32()), ("name", pa.string()), ("details", pa.map_(pa.string(), pa.string()))])))


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions over Arrow batches, for LATERAL joins.

    chunk_text(text, size, overlap): sentence chunks; extract_records(text,
    kind): spell or ic records.  Each is a function from a column to an array,
    called once per batch of rows, whose elements become the rows.
    """
    bound_batches(spark)
    spark.udf.register("chunk_text_array", F.arrow_udf(_chunk_batches, CHUNK_TYPE))
    spark.udf.register("extract_records_array", F.arrow_udf(_record_batches, RECORD_TYPE))
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(content STRING, size INT, overlap INT)
        RETURNS TABLE (chunk_index INT, text STRING, token_count INT)
        RETURN SELECT c.chunk_index, c.text, c.token_count FROM LATERAL explode(chunk_text_array(content, size, overlap)) AS t(c)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION extract_records(content STRING, kind STRING)
        RETURNS TABLE (record_no INT, name STRING, details MAP<STRING, STRING>)
        RETURN SELECT r.record_no, r.name, r.details FROM LATERAL explode(extract_records_array(content, kind)) AS t(r)""")
