"""Conversational-memory analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# ship the small task-side helpers with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
