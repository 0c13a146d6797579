"""assaykit: a PySpark-native data-quality and schema-validation engine."""

__version__ = "0.1.0"
