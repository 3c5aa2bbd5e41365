"""Matrix-free linear operators and inverse problems as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors get the functions they run with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
