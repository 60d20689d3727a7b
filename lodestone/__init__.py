"""lodestone: a Spark-first engine for hybrid search over documentation corpora.

Functions that run in Python workers are shipped by value, so a cluster's executors need the third-party
libraries of the environment but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
