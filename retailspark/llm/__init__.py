"""Operators for preparing training text: scans, packing, language, near copies, decontamination, vector search.

Nothing else in the library imports this package. Its functions run inside tasks, so they are pickled with their
code: executors need the public libraries only, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
