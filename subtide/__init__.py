"""subtide: a Spark-native engine for timed text (segments, cues, terms, translation memory, documents)."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
