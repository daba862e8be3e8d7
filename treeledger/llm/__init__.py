"""Operators that prepare training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# What runs in tasks is sent along with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
