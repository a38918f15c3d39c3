"""Emotion-corpus analytics on Spark.

Everything public takes and returns Columns or DataFrames.  Arrow functions
that run on executors are pickled by value, so a cluster needs only pyspark,
pyarrow and numpy on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
