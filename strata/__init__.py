"""Corpus and revision analytics on Spark DataFrames.

Functions that run in Python workers are pickled by value, so executors need
pyspark and the numeric libraries but not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
