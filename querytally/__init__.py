"""Spark-native analytics over relational tables and query evaluation results."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# The few functions that run in tasks travel with their code, so executors
# need not have the package installed.
register_pickle_by_value(sys.modules[__name__])
