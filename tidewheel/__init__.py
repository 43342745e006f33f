"""tidewheel: incremental and batch analytics over weighted collections on Spark.

A collection is a DataFrame plus a signed weight column.  Batch operators are
pure ``DataFrame -> DataFrame`` functions in :mod:`tidewheel.operators`; their
incremental forms live in :mod:`tidewheel.streaming`.
"""

__version__ = "0.1.0"
