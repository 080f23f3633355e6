"""Feature preparation, selection, resampling and scoring for labelled records on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers with their code, so executors need no copy of the package on their path.
__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
