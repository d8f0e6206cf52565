"""Change-event aggregation and corpus processing on PySpark."""
