"""Trip-fact analytics as PySpark DataFrame and Spark ML jobs."""

__version__ = "0.1.0"
