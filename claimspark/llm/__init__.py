"""Operators for preparing training corpora.

Each module is one operator over DataFrames. Functions that run in Python workers are
shipped by value, so executors need the third-party libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
