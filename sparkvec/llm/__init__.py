"""Training-data operators: sharding, fingerprints, scans, deduplication, tokens.

Nothing else in the library imports this subpackage.  Its functions are pickled
by value, so executors need numpy and pyarrow but not an installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
