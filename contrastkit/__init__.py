"""Spark-native analysis of class contrasts in observational data."""

__version__ = "0.1.0"
