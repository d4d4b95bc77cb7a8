"""Operators of a training-data pipeline: filters, deduplication, decontamination, redaction, archives and mixing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
