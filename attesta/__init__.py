"""A Spark-native engine for signed, provenanced evidence folded into uncertainty-aware ratings."""

__version__ = "0.1.0"
