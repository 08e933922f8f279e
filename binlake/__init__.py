"""binlake: program-analysis analytics as plain PySpark DataFrame operators."""
import sys

from pyspark import cloudpickle

# Arrow functions travel to executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
