"""Operators for building training data from large text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel inside the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
