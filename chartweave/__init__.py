"""Clinical-export analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors with their code, so a cluster
# needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
