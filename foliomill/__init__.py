"""foliomill: a Spark-first engine for indexing, comparing and querying document collections."""

__version__ = "0.1.0"
