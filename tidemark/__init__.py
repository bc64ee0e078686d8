"""tidemark: event-time analytics operators for PySpark.

Every operator is a function ``f(df, ...) -> DataFrame`` built from DataFrame
expressions, so Catalyst can prune columns, push filters into the parquet scan
and plan partial aggregation.  Streaming forms live in ``tidemark.streaming``.
"""

__version__ = "0.1.0"
