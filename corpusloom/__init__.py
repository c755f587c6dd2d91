"""Spark-native text-corpus analytics: every operator is a DataFrame plan."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
