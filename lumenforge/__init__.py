"""Spark-native analytics for multi-omics measurement data and corpus preparation."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to Python workers travel by value, so executors need not have this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
