"""Arrow helpers: whole texts as bytes, new columns beside the old ones, bounded pieces of a batch."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that are worked on at once; a single longer text is taken alone and whole.
PIECE_BYTES = 2 << 20


def text_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.binary()).to_pylist()


def pieces(texts: list, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) of texts with at most ``limit`` bytes each, or one text."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def parse_ddl(spark, ddl: str) -> StructType:
    """Fields of a DDL string, without a round trip through a DataFrame."""
    return StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else _parse_datatype_string(ddl)


def extend(df: DataFrame, ddl: str, factory: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Append the columns of ``ddl``, computed batch by batch in a narrow stage.

    ``factory()`` runs once per task and returns the function that maps a batch
    to its new columns.  Input columns with the same names are replaced.
    """
    new = parse_ddl(df.sparkSession, ddl)
    base = df.drop(*new.names)
    schema = StructType([*base.schema.fields, *new.fields])
    names = schema.names

    def run(batches):
        compute = factory()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch)], names=names)
    return base.mapInArrow(run, schema)
