"""Photo-job analytics as PySpark DataFrame queries."""
