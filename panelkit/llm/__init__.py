"""Training-data pipeline operators. Nothing else in the library imports this
subpackage; its queries are registered through :mod:`panelkit.llm.queries`."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
