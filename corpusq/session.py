"""Session defaults.  A cluster's own settings win; only unset ones are filled."""

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "corpusq", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """Read a table whose rows are costly to process (long texts).

    A large table arrives in many splits and is left alone.  A table in fewer
    splits than the session has cores is spread by the hash of its unique key,
    so that no core is idle and no value of another column can make a hot task.
    """
    df = load(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df
