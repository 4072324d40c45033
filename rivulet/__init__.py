"""Feed-archive analytics as declarative PySpark plans."""
