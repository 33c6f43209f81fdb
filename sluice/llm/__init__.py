"""Operators for preparing training data; nothing else in the library imports this subpackage.

Functions that run in tasks travel to the executors by value, so executors
need numpy, pyarrow and the tokenizer libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
