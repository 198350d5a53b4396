"""Streams of points."""
