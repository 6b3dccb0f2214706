"""quarryspark: a Spark-native engine for cleaning and condensing web corpora."""

__version__ = "0.1.0"
