"""Operators for preparing language-model training data on Spark.

Each module holds one operator with its own general interface;
``queries.py`` registers the queries that apply them to whole tables.
"""

import sys

from pyspark import cloudpickle

# Tasks get these functions with their code, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
