"""paperloom: document-collection analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions for Arrow batches travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
