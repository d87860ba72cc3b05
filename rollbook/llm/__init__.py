"""Training-data operators on Spark.

Nothing else in the library imports this package.  Its functions are
pickled by value, so executors need not have the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
