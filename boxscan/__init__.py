"""Motif-gene scanning over lakes of sequences, written as Spark DataFrame operators.

Every interval in the package is 0-based and half-open on the plus strand;
only the sinks convert to another convention.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so the package need not be
# installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
