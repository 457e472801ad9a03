"""mneme: a PySpark-native engine for note retrieval and corpus analytics."""

__version__ = "0.1.0"
