"""One row for each part of multi-part geometries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import native
from tessera.kernels.codecs import G
from tessera.types import SINGLE, Geo, GeoType, geo


def explode(df: DataFrame, name: str | None = None, index: str | None = None) -> DataFrame:
    """df with a row for each part, the other columns repeated and the geometry column moved to the end. Single-part rows stay; null and empty multi-part rows stay as null. index: name of a column for the part's place, from 0."""
    if name is None:
        from tessera.types import geometry_columns

        name = geometry_columns(df)[0]
    g = geo(df, name)
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    if g.type.kind in SINGLE:
        t = replace(g.type, kind=SINGLE[g.type.kind])
        parts = g.column
    elif g.type.native or g.type.kind == "box":
        t = g.type
        parts = F.array(g.column)
    else:
        from tessera.functions.kernel import unary
        from pyspark.sql import types as T

        t = replace(g.type, kind="geometry") if g.type.kind != "wkb" else g.type
        parts = unary(_parts, T.ArrayType(T.BinaryType()), g)
    one = F.explode_outer(parts).alias(name) if index is None else F.posexplode_outer(parts).alias(index, name)
    out = df.select(*others, one)
    return out.withColumn(name, Geo(F.col(f"`{name}`"), t).alias(name))


def geometries(df: DataFrame, name: str, kind: str, coords: Column, *offsets: Column, dim: str = "xy") -> DataFrame:
    """df with a row and a geometry column name for each geometry that native.from_offsets makes; rows without any stay, as null."""
    items = native.from_offsets(kind, coords, *offsets)
    out = df.select("*", F.explode_outer(items).alias(name))
    return out.withColumn(name, Geo(F.col(f"`{name}`"), GeoType(kind, dim)).alias(name))


def _parts(g: G) -> list[bytes]:
    from tessera.kernels.codecs import to_wkb

    if g.kind == "geometrycollection":
        return [to_wkb(x) for x in g.value]
    if g.kind in SINGLE:
        return [to_wkb(G(SINGLE[g.kind], g.dim, x)) for x in g.value]
    return [to_wkb(g)]
