"""Operators for preparing training corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so they need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
