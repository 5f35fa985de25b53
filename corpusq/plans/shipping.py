"""Values of checked size that every task holds."""

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Held:
    """A broadcast value whose classes travel with it; read it once per task with ``get()``."""

    def __init__(self, spark: SparkSession, value):
        self._shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return cloudpickle.loads(self._shared.value)
