"""leafmill: document analytics on Spark, declared with the DataFrame and SQL API."""

__version__ = "0.1.0"
