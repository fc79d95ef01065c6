"""A log-backed analytical table on PySpark: append-only, addressed by offsets, read as of any point."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
