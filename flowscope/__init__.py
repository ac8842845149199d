"""flowscope: network-behaviour analytics over HTTP flow logs, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code along, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
