"""corpusmill: a Spark-native text preparation engine."""

__version__ = "0.1.0"
