"""tracemill: experiment-log, catalog and text analytics on PySpark."""
