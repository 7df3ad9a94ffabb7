"""Tables of spectra and the evaluation of models on them, on Spark.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column expressions, kernels, metrics),
``operators`` (tasks, splits, fitted steps, estimators, results, rankings), ``plans`` (recipes and the
preprocessor), ``streaming`` (incremental scoring).
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with the query, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
