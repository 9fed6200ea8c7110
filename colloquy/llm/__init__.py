"""Operators for building training corpora; nothing else in the package imports this."""

import sys

from pyspark import cloudpickle

# Workers need no copy of this package on their path: functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
