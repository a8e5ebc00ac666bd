"""A PySpark-native engine for searching document collections and preparing training data."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
