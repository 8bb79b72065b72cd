"""Operators of a training-data pipeline: dedup, search, mixing, scans, formatting."""

import sys

from pyspark import cloudpickle

# Executors get the code of tasks with the job; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
