"""Spark-native analytics over documents, facts and text corpora."""

import sys

from pyspark import cloudpickle

# Functions travel to executors with their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
