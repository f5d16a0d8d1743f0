"""Build and query semantic maps of large document collections on Spark."""

import sys

from pyspark import cloudpickle

# Python tasks carry the helpers they use, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
