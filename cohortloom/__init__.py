"""Cohort construction and risk-score validation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python tasks carry the package's functions with them: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
