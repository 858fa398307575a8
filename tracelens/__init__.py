"""tracelens: a PySpark-native engine for software-diagnostics data and training corpora."""

__version__ = "0.1.0"
