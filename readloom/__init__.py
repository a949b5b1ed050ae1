"""readloom: overlap, mapping and consensus of long noisy reads as Spark jobs.

The package is shipped to Python workers by value, so a cluster needs no
installation of it on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
