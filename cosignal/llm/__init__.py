"""Operators for preparing training text at scale; nothing else in the library imports
this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
