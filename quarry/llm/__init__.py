"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
