"""draftsmith — Spark-native data engine for draft-model training data and draft-quality analytics."""

__version__ = "0.1.0"
