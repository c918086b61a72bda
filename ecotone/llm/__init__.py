"""Training-data operators.  Nothing else in the library imports this package.

The modules register themselves for pickling by value, so a cluster needs no
copy of this package on its executors to run the Arrow functions below.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
