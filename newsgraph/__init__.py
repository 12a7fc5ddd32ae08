"""News feed analytics on Spark: company scores, co-mention graph, exploration.

Functions that run in Python workers travel by value, so a worker needs no copy
of this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
