"""Provenance graph analytics, and operators for training-data corpora, on PySpark.

Functions of this package travel to the executors by value, so it need not be installed there."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
