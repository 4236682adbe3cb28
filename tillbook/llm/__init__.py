"""Operators of a training-data pipeline over large text corpora.

One module per operator; ``queries`` registers them on the given tables, ``common`` holds what several
share. Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job; workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
