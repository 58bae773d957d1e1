"""Evidence analytics on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
