"""Named queries over the given tables, each with a SQL twin where SQL can express it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from registry import files, ranking, scoring, spectral, splitting  # noqa: E402

MODULES = (spectral, splitting, scoring, ranking, files)
