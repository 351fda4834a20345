"""Operators for a training-data pipeline: near-duplicates, language, tokens, extraction, packing."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the job, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
