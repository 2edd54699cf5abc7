"""tracemill: a PySpark-native engine for evidence graphs, their quality and their evaluation."""

__version__ = "0.1.0"
