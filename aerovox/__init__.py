"""Flight-position and call-transcript analytics as plain Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python code that runs inside tasks travels with the query, so the executors need no copy
# of this package.
register_pickle_by_value(sys.modules[__name__])
