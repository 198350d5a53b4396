"""Geometries as Python values: codecs and algorithms."""
