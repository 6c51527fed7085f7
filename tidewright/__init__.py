"""Tools for teams moving a legacy SQL estate onto Spark."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
