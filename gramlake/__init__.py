"""A PySpark-native engine for empirical-frequency text analytics."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code along, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
