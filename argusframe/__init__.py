"""Spark-first analytics for camera and sensor observation data.

Python functions that run on executors are sent by value, so workers need
nothing of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
