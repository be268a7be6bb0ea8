"""Spark-native relations and operators for program and risk analysis."""

__version__ = "0.1.0"
