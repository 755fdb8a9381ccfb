"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
