"""lexframe: legal-bulletin data work as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside Python workers (pandas UDFs, mapInPandas,
# applyInPandas kernels) travel with the task by value, so executors need no copy of
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
