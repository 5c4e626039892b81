"""Spark-native extraction of compiled-script payloads, and SQL on what they hold."""

import sys

from pyspark import cloudpickle

# Executors get the kernels inside the pickled task, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
