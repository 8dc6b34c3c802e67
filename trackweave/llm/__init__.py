"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the ``opN_*`` queries in :mod:`trackweave.llm.entry` are
thin wrappers that turn operator results into digest columns.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers by value, so that executors
# need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
