"""Point-in-time valuation analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package by value: a cluster needs no copy of it on each machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
