"""A PySpark-native vector retrieval engine."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel with their code: executors need numpy and pyarrow, not an installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
