"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Functions of this subpackage travel to the executors by value, so that workers need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
