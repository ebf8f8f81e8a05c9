"""Fleet analytics on Spark: catalogs, registries, cluster snapshots and fetch logs as DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
