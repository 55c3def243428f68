"""Operators for preparing language-model training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the workers by value, so executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
