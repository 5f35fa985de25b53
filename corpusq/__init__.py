"""corpusq: corpus preparation, retrieval and record operators as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package with the task, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
