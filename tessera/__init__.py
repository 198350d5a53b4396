"""Columnar vector geometry on Spark."""
