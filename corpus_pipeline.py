"""From raw documents to balanced shards: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the docs of the next one; all but the last return the
columns of ``documents``.

All stages: an empty table gives an empty table; a row with a null id, text or
source is a row like any other; repeated rows are judged one by one, by the same
rule; columns beyond those of ``documents``, whatever their names, come back untouched.
"""

from pyspark.sql import DataFrame, SparkSession

from corpusq.llm import decontam, mixing, neardup, queries, sharding
from corpusq.plans.scratch import shared_folder
from corpusq.session import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not reject.

    A null text counts as empty and is scored like one.  A null id is scored,
    never learned from; rows with one id teach with one text.
    """
    return queries.without_toxic(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    A null or empty text is no copy of anything; a row with a null id stays.  Of
    an id with several texts only the rows whose text is a copy go; all rows of the
    smallest id stay.
    """
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; a null or empty text has none."""
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target of its source asks for.

    A null source is a source of its own.  A null or empty text has no words
    and is taken at the rate of its source.  Rows with one id take the same draw.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, shard and slot.

    A null text has no bytes and shares the group of the empty text.  An own
    column with one of these four names comes as own_<name>.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"pipeline-{at}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES, ORACLES = {"pipeline": run}, {}
