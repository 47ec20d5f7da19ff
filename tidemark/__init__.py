"""Market-data and risk analytics as Spark jobs over long `(symbol, ts)` tables."""
import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
