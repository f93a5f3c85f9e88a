"""lattica: a spreadsheet query language compiled to Spark DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to executors travel by value, so workers need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
