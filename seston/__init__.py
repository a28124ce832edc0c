"""Cleaning and community analysis of sample x taxon x count tables on Spark.

Every public operator takes DataFrames or Columns and returns DataFrames or
Columns; nothing runs until the caller acts on the result unless the
docstring says so.
"""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the plan, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
