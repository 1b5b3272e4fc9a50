"""hydroframe: a PySpark-native analytics engine for environmental monitoring measurements."""

__version__ = "0.1.0"
