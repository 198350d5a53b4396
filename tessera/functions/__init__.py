"""Spatial functions. native: Column expressions; kernel: Arrow-batched Python. Here: those that pick by the column's type."""

from __future__ import annotations

from pyspark.sql import Column

from tessera.functions import kernel, native
from tessera.types import Geo, GeoError


def _native(g: Geo) -> bool:
    return g.type.native or g.type.kind == "box"


def area(g: Geo, method: str = "euclidean") -> Column:
    """Unsigned. euclidean, spherical (Chamberlain-Duquette) or ellipsoidal."""
    if method == "ellipsoidal":
        return kernel.geodesic_unsigned_area(g)
    return {"euclidean": native.unsigned_area, "spherical": native.chamberlain_duquette_unsigned_area}[method](g)


def signed_area(g: Geo, method: str = "euclidean") -> Column:
    if method == "ellipsoidal":
        return kernel.geodesic_signed_area(g)
    return {"euclidean": native.signed_area, "spherical": native.chamberlain_duquette_signed_area}[method](g)


def length(g: Geo, method: str = "euclidean") -> Column:
    """euclidean, haversine, vincenty or ellipsoidal."""
    return {"euclidean": native.euclidean_length, "haversine": native.haversine_length, "vincenty": kernel.vincenty_length, "ellipsoidal": kernel.geodesic_length}[method](g)


def distance(a: Geo, b: Geo) -> Column:
    if a.type.kind == b.type.kind == "point":
        return native.point_distance(a, b)
    return kernel.euclidean_distance(a, b)


def contains(a: Geo, b: Geo) -> Column:
    if a.type.kind == "polygon" and b.type.kind == "point":
        return native.polygon_contains_point(a, b)
    return kernel.contains(a, b)


def within(a: Geo, b: Geo) -> Column:
    return contains(b, a)


def intersects(a: Geo, b: Geo) -> Column:
    for x, y in ((a, b), (b, a)):
        if x.type.kind == "polygon" and y.type.kind == "point":
            return native.polygon_intersects_point(x, y)
    if a.type.kind == b.type.kind == "box":
        return native.bbox_intersects(a, b)
    return kernel.intersects(a, b)


def simplify(g: Geo, epsilon: float | Column, method: str = "rdp") -> Geo:
    """rdp, vw or vw_preserve."""
    return {"rdp": kernel.simplify, "vw": kernel.simplify_vw, "vw_preserve": kernel.simplify_vw_preserve}[method](g, epsilon)


def cast(g: Geo, t) -> Geo:
    return kernel.cast(g, t)


__all__ = ["GeoError", "area", "cast", "contains", "distance", "intersects", "kernel", "length", "native", "signed_area", "simplify", "within"]
