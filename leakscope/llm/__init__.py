"""Operations of a training-data pipeline: search, deduplication, formatting, pseudonyms, archives, quality, mixing.

Nothing outside this package imports it. Each module holds one operator with its own interface; `queries` applies the
operators to the test tables.
"""
from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to the executors by value, so Python workers need no copy of this package on their path.
register_pickle_by_value(sys.modules[__name__])
