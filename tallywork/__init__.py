"""tallywork: a PySpark-native engine for tables, surveys and text."""

__version__ = "0.1.0"
