"""recspark: recommendation analytics as Spark DataFrame operators.

Sub-packages:
  sources    readers, writers and views over the benchmark tables
  functions  Column-level helpers (vectors, hashing, statistics)
  operators  DataFrame-in / DataFrame-out operators (prep, scoring, metrics, ...)
  plans      named query plans registered for the driver and the DuckDB oracle
  streaming  Structured Streaming versions of the monitoring operators
"""

from recspark.session import configure, get_spark, checkpoint_dir

__all__ = ["configure", "get_spark", "checkpoint_dir"]
