"""Text annotation and training-data analytics on Spark."""

import sys

from pyspark import cloudpickle

# executors need no installed copy: functions of this package travel with the plans that use them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
