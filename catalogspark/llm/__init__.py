"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``conversations``. Nothing else imports them."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
