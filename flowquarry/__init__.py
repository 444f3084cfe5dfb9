"""flowquarry: analytics and data-preparation operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors carry their code, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
