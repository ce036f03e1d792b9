"""Document layout analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python workers may run where this package is not on the path: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
