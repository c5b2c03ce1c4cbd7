"""Tabular analytics and data-quality operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: executors need numpy and pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
