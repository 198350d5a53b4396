"""Geometries for tests: each kind with a null and an empty row."""

import math

from tessera.types import GeoType, linestring, multilinestring, multipoint, multipolygon, point, polygon

NAN = math.nan
WKT = {
    "point": ["POINT (30 10)", "POINT (40 20)", None, "POINT EMPTY"],
    "linestring": ["LINESTRING (30 10, 10 30, 40 40)", "LINESTRING (40 20, 20 40, 50 50)", None, "LINESTRING EMPTY"],
    "polygon": ["POLYGON ((30 10, 40 40, 20 40, 10 20, 30 10))", "POLYGON ((35 10, 45 45, 15 40, 10 20, 35 10), (20 30, 35 35, 30 20, 20 30))", None, "POLYGON EMPTY"],
    "multipoint": ["MULTIPOINT ((30 10))", "MULTIPOINT ((10 40), (40 30), (20 20), (30 10))", None, "MULTIPOINT EMPTY"],
    "multilinestring": ["MULTILINESTRING ((30 10, 10 30, 40 40))", "MULTILINESTRING ((10 10, 20 20, 10 40), (40 40, 30 30, 40 20, 30 10))", None, "MULTILINESTRING EMPTY"],
    "multipolygon": ["MULTIPOLYGON (((30 20, 45 40, 10 40, 30 20)))", "MULTIPOLYGON (((40 40, 20 45, 45 30, 40 40)), ((20 35, 10 30, 10 10, 30 5, 45 20, 20 35), (30 20, 20 15, 20 25, 30 20)))", None, "MULTIPOLYGON EMPTY"],
}
TYPES: dict[str, GeoType] = {t.kind: t for t in (point(), linestring(), polygon(), multipoint(), multilinestring(), multipolygon())}


def column(spark, kind):
    """A frame with i and a native column g."""
    from pyspark.sql import functions as F

    from tessera.functions import kernel

    df = spark.createDataFrame(list(enumerate(WKT[kind])), "i int, w string")
    return df.select("i", kernel.from_wkt(F.col("w"), TYPES[kind]).alias("g"))


def from_wkt(spark, rows, kind):
    from pyspark.sql import functions as F

    from tessera.functions import kernel

    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, " + ", ".join(f"w{k} string" for k in range(len(rows[0]))))
    return df.select("i", *[kernel.from_wkt(F.col(f"w{k}"), t).alias(f"g{k}") for k, t in enumerate(kind)])
