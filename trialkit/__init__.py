"""Emulating clinical trials from event records, as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Worker functions travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
