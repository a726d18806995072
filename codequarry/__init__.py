"""codequarry: code intelligence as Spark DataFrames.

Chunks, call edges, inheritance edges and routes are plain DataFrames;
operators are functions from DataFrame to DataFrame.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run inside tasks travel with the task: workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
