"""Tributary: lineage analysis and warehouse marts as PySpark DataFrame pipelines."""

__version__ = "0.1.0"
