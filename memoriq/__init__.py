"""Time-aware retrieval analytics over short texts, expressed as Spark plans.

Python functions of this package are shipped to executors by value, so a
cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
