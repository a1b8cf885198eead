"""Terrace: evidence retrieval and graph analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
