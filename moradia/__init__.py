"""Listing analytics on Spark: search, quality, merge, extraction, fusion and corpus operators."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
