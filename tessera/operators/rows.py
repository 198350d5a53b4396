"""Rows by place: gathering and slicing. Rows of a table have no order of their own, so places are a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.types import free_name


def take(df: DataFrame, place: str, indices: DataFrame, index: str) -> DataFrame:
    """A row for each row of indices: the row of df whose column place equals index. A null index, and one that is not there, gives nulls; places must be unique. indices' other columns stay."""
    key = f"{free_name(df, indices)}place"
    return indices.join(df.withColumnRenamed(place, key), F.col(index) == F.col(key), "left").drop(key)


def take_range(df: DataFrame, place: str, start: int, stop: int) -> DataFrame:
    """Rows with places from start up to but without stop: a filter that reaches the scan."""
    return df.filter((F.col(place) >= start) & (F.col(place) < stop))


def rechunk(df: DataFrame, place: str, rows: int) -> DataFrame:
    """df with a column chunk, dealt so that rows of one chunk of so many places are in one task."""
    if "chunk" in df.columns:
        raise ValueError("rename the column chunk: the result has one")
    return df.withColumn("chunk", F.floor(F.col(place) / rows).cast("long")).repartition("chunk")
