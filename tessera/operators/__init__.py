"""Joins, explode, downcast, rows by place."""
