"""quotemill: a PySpark-native engine for cleaning, joining and measuring market quotes."""

__version__ = "0.1.0"
