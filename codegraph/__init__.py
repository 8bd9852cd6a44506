"""Spark-native code-intelligence engine: definitions, references, graphs and similarity as DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions shipped to executors carry their code, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
