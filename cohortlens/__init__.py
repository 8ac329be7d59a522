"""Spark-native survey, segmentation and preference analytics."""

__version__ = "0.1.0"
