"""Registry analytics on Spark: records to features, models, scores and attribution."""

import sys

from pyspark import cloudpickle

# Python functions shipped to tasks carry their helpers along, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
