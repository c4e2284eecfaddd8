"""Siftline: security analytics over text and code corpora, written as Spark dataflows."""

import sys

from pyspark import cloudpickle

# functions travel to the Python workers by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
