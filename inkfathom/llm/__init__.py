"""Operators for building training corpora at scale; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get the operators' Python functions with the task, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])
