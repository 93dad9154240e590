"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

#: Executors unpickle the Python functions of these operators by value, so they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
