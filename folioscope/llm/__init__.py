"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
