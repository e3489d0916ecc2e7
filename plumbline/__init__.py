"""Plumbline: find out what is in a table before doing anything to it.

Every operator takes a Spark DataFrame and returns a DataFrame; the source is
only read.  ``operators`` holds the analyses, ``functions`` the shared pieces
(column selection, exact quantiles, global row order, tail probabilities),
``sources`` readers and writers, ``plans`` whole-report jobs.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
