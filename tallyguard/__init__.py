"""Transaction surveillance on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# the few functions that run inside Python workers travel with their tasks, so that
# executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
