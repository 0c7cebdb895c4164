"""sangam: a PySpark-native analytics engine for parallel and code-mixed text corpora."""

__version__ = "0.1.0"
