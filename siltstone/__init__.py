"""siltstone: evidence analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the package's functions by value, so that executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
