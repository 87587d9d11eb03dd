"""Training-data operators over the synthetic corpus tables.

Nothing outside this folder imports it; it may use general helpers of the
library.  Each module is one operator with its own interface; ``catalog``
holds the thin registered queries.
"""
