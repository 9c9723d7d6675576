"""weftline: Spark-first engine for coding-assistant session data."""

__version__ = "0.1.0"
