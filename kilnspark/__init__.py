"""kilnspark: training-data curation as lazy PySpark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# functions and classes of this package travel to Python workers by value, so workers need not be able to import it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
