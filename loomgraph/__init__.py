"""Search and exploration of large document collections as an event-entity graph, on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the job, so that it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
