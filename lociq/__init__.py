"""A PySpark engine for aligned reads, intervals and genotypes."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, which need no copy of this package. A module that such a function names
# goes whole, so modules hold no UDF: once used, it has a handle of the JVM, which can't be sent.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
