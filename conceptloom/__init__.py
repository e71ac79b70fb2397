"""Formal Concept Analysis on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The small functions run inside tasks travel with the job, so executors need
# only numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
