"""A Spark-native archive of bookmarked blocks: ingest, block and vector tables,
cosine search, neighbour graph and retrieval contexts, all as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions for the Python stages travel inside the task, so the executors need numpy and
# pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
