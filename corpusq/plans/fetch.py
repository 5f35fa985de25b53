"""Rows of a large table by a list of ids, without sorting the table."""

from pyspark.sql import DataFrame, functions as F

from corpusq.plans.scratch import keep, shared_folder

#: Ids that every task may hold; more are met by a hash join.
HELD_IDS = 1_000_000


def _stored(ids: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """(the ids, written once so that they are counted and used without being computed twice; whether they are few)."""
    path = shared_folder(ids.sparkSession, name)
    ids.write.parquet(path)
    kept = ids.sparkSession.read.schema(ids.schema).parquet(path)
    return kept, kept.limit(HELD_IDS + 1).count() <= HELD_IDS


def without_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is not among ``ids``; the table is neither sorted nor, for few ids, moved."""
    gone, few = _stored(ids.select(key), "without")
    return table.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), key, "left_anti")


def fetch_rows(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``ids`` (key and any other columns) joined with the rows of ``table`` that have these keys.

    Few ids travel to the table: its rows are picked where they lie and only
    those go on.  Many ids and the table are spread by the key and met by a hash
    table of the ids, not by a sort of the table.
    """
    kept, few = _stored(ids, "fetch")
    if few:
        wanted = kept.select(key).filter(F.col(key).isNotNull())
        return kept.join(table.join(F.broadcast(wanted), key, "left_semi"), key)
    return table.join(kept.hint("shuffle_hash"), key).select(*kept.columns, *[c for c in table.columns if c != key])


def pick_rows(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose number ``key`` is among ``ids``, each once.

    The numbers travel to the table as one bit each, so rows are picked where they lie as
    long as the numbers lie in at most HELD_IDS words of 64.
    """
    word, place = F.shiftright(F.col(key), 6), F.col(key).bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    words = keep(ids.filter(F.col(key).isNotNull()).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")), "pick")
    few = words.limit(HELD_IDS + 1).count() <= HELD_IDS
    met = table.withColumn("_word", word).join(F.broadcast(words) if few else words.hint("shuffle_hash"), "_word")
    return met.filter(F.getbit("_bits", place) == 1).select(*table.columns)
