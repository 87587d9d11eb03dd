"""clientele — a Spark-native client-repository engine.

Turns crawled company pages and model replies into a deduplicated,
tenant-keyed repository of each company's clients and technology
partners, and answers analytical questions over it.  Every operator is
a ``DataFrame -> DataFrame`` (or ``Column -> Column``) function so that
Catalyst sees the whole plan.
"""

import sys as _sys

try:
    # Ship the package's own Python (pandas / Arrow steps) to executors by
    # value, so workers need not have it installed or on their path.
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 -- older cloudpickle: rely on --py-files
    pass

__all__ = ["session"]
