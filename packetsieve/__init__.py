"""Finds unusual traffic in packet captures with Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in tasks travel with the job, so the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
