"""Operators of a training-data pipeline: filters, near-duplicate detection, search, tokenising, mixing.

Nothing outside this folder imports it.  Each module holds one operator with a general interface; ``queries`` registers
the thin queries over the driver's tables.  Python helpers travel to the workers by value, so executors need no copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
