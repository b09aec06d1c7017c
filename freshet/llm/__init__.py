"""Operators of a training-data pipeline: sharding, cleaning, scoring, joining and packing texts.

Every operator takes and returns DataFrames. Python, where used, works on Arrow batches cut to a
few megabytes of text, so memory does not depend on the number or the length of documents.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks with their code: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
