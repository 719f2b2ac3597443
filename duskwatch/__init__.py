"""Security-log analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
