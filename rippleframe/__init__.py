"""Signal analytics over ordered numeric streams, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions and processors travel to the Python workers by value, so a cluster needs
# no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
