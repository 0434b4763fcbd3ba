"""A Spark-first engine for time-ordered signals, live transcripts, text and vectors."""

import sys

from pyspark import cloudpickle

# Functions that run on workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
