"""skyframe: FITS images, tables and array codecs as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
