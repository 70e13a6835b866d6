"""loomline: a Spark-native engine for code lineage, retrieval and training-data preparation."""

__version__ = "0.1.0"
