"""Catalog data platform on Spark: extraction, integration, faceted search and price evidence."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
