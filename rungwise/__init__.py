"""Spark-native operators for building step-level preference data from reasoning text."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
