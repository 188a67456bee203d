"""lamina: a PySpark-native engine for keyed arrays, ordered signals and text corpora.

Functions that run on executors are pickled by value, so a cluster needs no copy of
this package on its workers' Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
