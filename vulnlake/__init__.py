"""Code-security analytics as PySpark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run in Python workers travel with the task, so the
# package need not be installed on the executors.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
