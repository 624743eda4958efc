"""Training-data operators: extraction, deduplication, filtering, mixing, packing.

Functions that run inside Python workers are pickled by value, so executors need
only the third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
