"""Training-data operators: ten corpus operators and their queries.

Nothing outside this subpackage imports it.  Its functions are pickled by value, so that
executors need no copy of the package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
