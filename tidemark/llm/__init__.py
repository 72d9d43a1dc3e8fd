"""Operators for building language-model training data."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
