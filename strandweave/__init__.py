"""Spark-native analytics for segmented multivariate time series."""

__version__ = "0.1.0"
