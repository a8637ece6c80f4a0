"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator lives in its own
module; ``queries`` registers one query per operator, ``sql`` holds their DuckDB text.
"""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code: no executor needs this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
