"""pairwright: prepare and evaluate (question, query) corpora as Spark jobs."""

import sys

from pyspark import cloudpickle

from pairwright.config import Settings

# The few functions that run in Python workers travel with the job, so executors do not have
# to have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
