"""Spark-native curation of time-aligned speech, video and text training data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions by value, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
