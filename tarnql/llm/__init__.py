"""Operators for preparing training data: ten corpus operators over documents and pages.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
