"""Operators for a training-data pipeline. Nothing else in the library imports this package.

Its functions travel to the executors by value, so these need no copy of the library.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
