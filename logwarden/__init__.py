"""logwarden: security-log analytics as PySpark DataFrame transformations.

The package is a set of ``DataFrame -> DataFrame`` functions, ``pyspark.ml``
estimators and Structured Streaming queries.  See the README for the map.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their code, so executors
# need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
