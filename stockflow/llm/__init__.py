"""Operators for building training data from text.

Nothing else in the library imports this package. Its functions travel to the
executors by value, so workers need no package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
