"""Operators for training-data pipelines. Nothing outside this folder and the entry file uses them.

Functions that run in Python workers travel with the job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
