"""strandlake: an omics analytics engine expressed over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value: a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
