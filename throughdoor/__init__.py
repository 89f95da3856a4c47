"""Scorecard and reject-inference analytics on Spark DataFrames."""
import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
