"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so executors need the third-party libraries only, not
this repository.
"""

from pyspark import cloudpickle

import tessera

cloudpickle.register_pickle_by_value(tessera)
