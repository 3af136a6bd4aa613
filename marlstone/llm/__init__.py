"""Training-data operators.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so only the driver needs the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
