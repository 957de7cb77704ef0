"""Embedding, attention and cohort analytics as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Helpers used inside tasks travel with the job; executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
