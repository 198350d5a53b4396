"""Queries over the business tables."""
