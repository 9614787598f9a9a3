"""panelspark: a Spark-first engine for cross-sectional factor research on panels."""

__version__ = "0.1.0"
