"""lettermill: mailbox and text-corpus analytics written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task code travels by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
