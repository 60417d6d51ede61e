"""Operators for preparing training text, each one Spark job over whole tables.

Nothing else in the library imports this package. Its functions are pickled by value, so
executors need the public libraries only, not a copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
