"""tidemark: a Spark-native lakehouse analytics engine."""

__version__ = "0.1.0"
