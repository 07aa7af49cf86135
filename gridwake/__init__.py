"""gridwake: Spark-native analytics for pixel time series and training-data preparation."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
