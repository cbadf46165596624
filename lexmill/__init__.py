"""lexmill: a Spark-first engine for text-retrieval data work on contracts."""

__version__ = "0.1.0"
