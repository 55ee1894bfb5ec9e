"""helixframe: a Spark-native engine for genome-wide signal data."""

__version__ = "0.1.0"
