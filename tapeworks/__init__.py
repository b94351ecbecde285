"""tapeworks: a Spark-native engine for limit-order-book event data."""

__version__ = "0.1.0"
