"""The narrowest type that a mixed column's rows have in common, over the whole table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from tessera.functions import native
from tessera.functions.kernel import cast, to_wkb
from tessera.types import DIMS, KINDS, GeoError, GeoType, geo


def common_type(type_ids: set[int], like: GeoType) -> GeoType | None:
    """One kind: itself; a kind and its multi-part form: the latter; else none. Dimensions must be equal. No ids at all is an error."""
    if not type_ids:
        raise GeoError("no geometry to take a type from")
    if len({i // 10 for i in type_ids}) > 1:
        return None
    dim, kinds = DIMS[next(iter(type_ids)) // 10], {KINDS[i % 10 - 1] for i in type_ids}
    if len(kinds) == 1:
        return replace(like, kind=kinds.pop(), dim=dim)
    single = {k.removeprefix("multi") for k in kinds}
    return replace(like, kind=f"multi{single.pop()}", dim=dim) if len(single) == 1 else None


def infer_downcast_type(df: DataFrame, name: str) -> GeoType | None:
    """A global aggregate: the driver gets at most 28 ids. Multi-part columns whose rows have one part each count as single-part."""
    g = geo(df, name)
    if g.type.kind in ("multipoint", "multilinestring", "multipolygon"):
        from pyspark.sql import functions as F

        most = df.agg(F.max(F.size(g.column)).alias("n")).first()[0]
        if most is None:
            raise GeoError("no geometry to take a type from")
        return replace(g.type, kind=g.type.kind.removeprefix("multi")) if most <= 1 else g.type
    if g.type.native:
        return g.type
    b = to_wkb(g)
    found = native.unique_type_ids(df, b).first()[0]
    return common_type(set(found), g.type)


def downcast(df: DataFrame, name: str) -> DataFrame:
    """df with the column in its narrowest type; unchanged if there is none."""
    t = infer_downcast_type(df, name)
    return df if t is None else df.withColumn(name, cast(geo(df, name), t).alias(name))
