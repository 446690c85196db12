"""Tarnwell: Spark-native analytics over source trees and text corpora."""

import sys

from pyspark import cloudpickle

# functions go to executors by value, so those need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
