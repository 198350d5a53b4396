"""Functions that need whole geometries at once: Arrow-batched Python kernels on native or WKB columns.

NULL gives NULL. An empty point is NULL to predicates and measures where the
kernel has no value for it; strict=True raises instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.kernels import arrange, codecs, geodesic, planar, wkb
from tessera.kernels.codecs import G
from tessera.types import DEPTH, Geo, GeoError, GeoType, check_same

_EMPTY_POINT = "an empty point has no place"


def _lists(values: pa.Array, depth: int, dim: str) -> list | None:
    """Nested lists of vertex tuples from the buffers of lists of structs; None if something within is null."""
    if not depth:
        if values.null_count:
            return None
        axes = [values.field(k) for k in range(len(dim))]
        return None if any(a.null_count for a in axes) else list(zip(*(a.to_numpy().tolist() for a in axes), strict=True))
    flat = _lists(values.flatten(), depth - 1, dim)  # what null lists may hold is left out
    if flat is None:
        return None
    ends = np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[i:j] for i, j in zip([0, *ends], ends)]


def decode(values: pa.Array, t: GeoType) -> list[G | None]:
    """Arrow values of a geometry column as Python geometries."""
    if t.native and t.kind != "point" and [f.name for f in _leaf(values.type)] == list(t.dim) and not any(x.null_count for x in _inner(values)):
        rows = _lists(values, DEPTH[t.kind], t.dim)
        if rows is not None:
            return [G(t.kind, t.dim, v) if ok else None for v, ok in zip(rows, values.is_valid().to_pylist(), strict=True)]
    rows = values.to_pylist()
    if t.native or t.kind == "box":
        return [codecs.from_native(t.kind, t.dim, v) for v in rows]
    read = codecs.from_wkt if t.kind == "wkt" else codecs.from_wkb
    return [None if v is None else read(v) for v in rows]


def _leaf(t: pa.DataType) -> pa.DataType:
    while pa.types.is_list(t) or pa.types.is_large_list(t):
        t = t.value_type
    return t


def _inner(values: pa.Array) -> list[pa.Array]:
    """The lists within lists."""
    out = []
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        values = values.flatten()
        out.append(values)
    return out


def encode(rows: list[G | None], t: GeoType) -> pa.Array:
    """Python geometries as Arrow values of a geometry column."""
    if t.native and t.kind != "point":
        # level by level: how long each list is, then the vertices
        level, offsets = [None if g is None else g.value for g in rows], []
        for _ in range(DEPTH[t.kind]):
            offsets.append(np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in level])]).astype(np.int32))
            level = [x for v in level if v is not None for x in v]
        axes = zip(*level, strict=True) if level else [[]] * len(t.dim)
        out = pa.StructArray.from_arrays([pa.array(a, pa.float64()) for a in axes], list(t.dim))
        for k in range(len(offsets) - 1, -1, -1):
            nulls = pa.array([g is None for g in rows]) if k == 0 and None in rows else None
            out = pa.ListArray.from_arrays(pa.array(offsets[k]), out, mask=nulls)
        return out.cast(to_arrow_type(t.storage))
    if t.native:
        return pa.array([codecs.to_native(g) for g in rows], to_arrow_type(t.storage))
    write = codecs.to_wkt if t.kind == "wkt" else codecs.to_wkb
    return pa.array([None if g is None else write(g) for g in rows], pa.string() if t.kind == "wkt" else pa.binary())


def _call(f: Callable[..., Any], out: T.DataType | GeoType, geos: list[Geo], others: list[Column] = (), fast: Callable[..., pa.Array | None] | None = None) -> Column:
    """f row by row over geometry columns and further columns; NULL in any gives NULL. fast: whole Arrow arrays at once, or None where it cannot."""
    types = [g.type for g in geos]
    n, kind = len(geos), out.storage if isinstance(out, GeoType) else out
    arrow = None if isinstance(out, GeoType) else to_arrow_type(out)

    def run(arrays: tuple[pa.Array, ...]) -> pa.Array:
        if fast is not None and (found := fast(*arrays)) is not None:
            return found.cast(to_arrow_type(kind))
        cols = [decode(a, t) for a, t in zip(arrays, types)] + [a.to_pylist() for a in arrays[n:]]
        rows = [None if any(v is None for v in row) else f(*row) for row in zip(*cols, strict=True)]
        return encode(rows, out) if isinstance(out, GeoType) else pa.array(rows, arrow)

    return F.arrow_udf(_of_arity(run, n + len(others)), kind)(*[g.column for g in geos], *others)


def _of_arity(run: Callable[[tuple[pa.Array, ...]], pa.Array], n: int) -> Callable[..., pa.Array]:
    """run as a function of one, two or three Arrow arrays, as the type hints of arrow_udf ask for."""

    def one(a: pa.Array) -> pa.Array:
        return run((a,))

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run((a, b))

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run((a, b, c))

    return (one, two, three)[n - 1]


def _number(c: float | Column) -> Column:
    return c.cast("double") if isinstance(c, Column) else F.lit(float(c))


def _xy(t: GeoType, kind: str) -> GeoType:
    return replace(t, kind=kind, dim="xy")


# codecs


def to_wkb(g: Geo) -> Geo:
    t = replace(g.type, kind="wkb")
    if g.type.kind in ("wkb", "geometry"):
        return g
    kind, dim = g.type.kind, g.type.dim
    return Geo(_call(lambda x: x, t, [g], fast=lambda a: wkb.encode(a, kind, dim)), t)


def to_wkt(g: Geo) -> Geo:
    t = replace(g.type, kind="wkt")
    fast = wkb.lines_to_text if (g.type.kind, g.type.dim) == ("linestring", "xy") else None
    return g if g.type.kind == "wkt" else Geo(_call(lambda x: x, t, [g], fast=fast), t)


def _fit(g: G, t: GeoType) -> G:
    """A geometry as a row of a column of type t; raises if it does not fit."""
    if t.kind in ("wkb", "wkt", "geometry"):
        # a mixed column unwraps a collection of one
        return g.value[0] if t.kind == "geometry" and g.kind == "geometrycollection" and len(g.value) == 1 else g
    if t.kind == "geometrycollection":
        return g if g.kind == t.kind else G(t.kind, g.dim, [g])
    if g.dim != t.dim:
        raise GeoError(f"a geometry in {g.dim} does not fit a column in {t.dim}")
    if g.kind == "geometrycollection" and len(g.value) == 1:
        g = g.value[0]
    if g.kind == t.kind:
        return g
    if "multi" + g.kind == t.kind:
        return G(t.kind, g.dim, [] if g.value is None else [g.value])
    if g.kind == "multi" + t.kind and len(g.value) <= 1:
        return G(t.kind, g.dim, g.value[0] if g.value else None if t.kind == "point" else [])
    raise GeoError(f"a {g.kind} does not fit a column of {t.kind}")


def from_wkb(c: Column, t: GeoType) -> Geo:
    """WKB as a column of type t. Boxes are refused."""
    if t.kind == "box":
        raise GeoError("WKB has no boxes")
    return Geo(_call(lambda x: _fit(x, t), t, [Geo(c, GeoType("wkb"))], fast=lambda a: wkb.decode(a, t.kind, t.dim)), t)


def from_wkt(c: Column, t: GeoType) -> Geo:
    if t.kind == "box":
        raise GeoError("WKT has no boxes")
    fast = wkb.lines_from_text if (t.kind, t.dim) == ("linestring", "xy") else None
    return Geo(_call(lambda x: _fit(x, t), t, [Geo(c, GeoType("wkt"))], fast=fast), t)


def as_geojson(g: Geo) -> Column:
    import json

    return _call(lambda x: json.dumps(codecs.to_geojson(x), separators=(",", ":")), T.StringType(), [g])


def from_geojson(c: Column, t: GeoType) -> Geo:
    def read(text: str) -> G:
        return _fit(codecs.from_geojson(text), t)

    return Geo(_call(read, t, [], [c]), t)


def cast(g: Geo, t: GeoType) -> Geo:
    """g as a column of type t.

    Dimensions must agree where both are known, CRS and edges always. Single to
    multi-part always works, multi to single-part for rows of at most one part.
    Boxes go to WKB and WKT only. Mixed and serialized columns go to any kind
    that every row fits.
    """
    known = lambda k: k.native or k.kind in ("box", "geometrycollection")
    if known(g.type) and known(t) and g.type.dim != t.dim:
        raise GeoError(f"{g.type.dim} and {t.dim} are different dimensions")
    if not g.type.same_reference(t):
        raise GeoError("a cast does not change the coordinate reference system")
    if g.type.kind == "box" and t.kind not in ("wkb", "wkt"):
        raise GeoError("a box only casts to WKB and WKT")
    if t.kind == "box":
        raise GeoError("nothing casts to a box")
    if g.type == t:
        return g
    if g.type.native and t.native:
        from tessera.functions import native

        if t.kind == "multi" + g.type.kind:
            return native.to_multi(g)
        if g.type.kind == "multi" + t.kind:
            return native.to_single(g)
        raise GeoError(f"a {g.type.kind} column does not cast to {t.kind}")
    return Geo(_call(lambda x: _fit(x, t), t, [g]), t)


# predicates


def _pair(name: str, a: Geo, b: Geo, strict: bool) -> Column:
    check_same(a, b)

    def run(x: G, y: G) -> bool | None:
        if any(v.kind == "point" and v.value is None for v in (x, y)):
            if strict:
                raise GeoError(_EMPTY_POINT)
            return None
        p, q = _box(x), _box(y)
        if p is None or q is None or p[2] < q[0] or q[2] < p[0] or p[3] < q[1] or q[3] < p[1]:
            if name == "disjoint":
                return True
            if not (name == "equals" and p is None and q is None):
                return False
        elif name in _HOLDS and not _holds(*((p, q) if name in ("contains", "covers", "equals") else (q, p)), name == "equals"):
            return False
        return arrange.predicate(name, x, y)

    return _call(run, T.BooleanType(), [a, b])


#: Predicates that need one box to hold the other.
_HOLDS = {"contains", "covers", "within", "covered_by", "equals"}


def _holds(p: tuple[float, ...], q: tuple[float, ...], same: bool) -> bool:
    return p == q if same else p[0] <= q[0] and p[1] <= q[1] and p[2] >= q[2] and p[3] >= q[3]


def _box(g: G) -> tuple[float, float, float, float] | None:
    ps = [p[:2] for p in codecs.vertices(g)]
    return (min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps)) if ps else None


def _predicate(name: str, doc: str) -> Callable[..., Column]:
    def f(a: Geo, b: Geo, strict: bool = False) -> Column:
        return _pair(name, a, b, strict)

    f.__name__, f.__doc__ = name, doc
    return f


contains = _predicate("contains", "b lies in a and their interiors meet.")
within = _predicate("within", "a lies in b and their interiors meet.")
intersects = _predicate("intersects", "They have a point in common.")
disjoint = _predicate("disjoint", "They have no point in common.")
crosses = _predicate("crosses", "Their interiors meet in something of lower dimension, and neither holds the other.")
touches = _predicate("touches", "They meet, but not their interiors.")
overlaps = _predicate("overlaps", "Their interiors meet in their own dimension, and neither holds the other.")
equals = _predicate("equals", "They are the same point set.")
covers = _predicate("covers", "No point of b lies outside of a.")
covered_by = _predicate("covered_by", "No point of a lies outside of b.")


def relate(a: Geo, b: Geo) -> Column:
    """The nine-intersection matrix as nine characters."""
    check_same(a, b)
    return _call(arrange.relate, T.StringType(), [a, b])


def relate_pattern(a: Geo, b: Geo, pattern: str) -> Column:
    """Whether the matrix fits a pattern of T, F, *, 0, 1 and 2."""
    if len(pattern) != 9 or set(pattern) - set("TF*012"):
        raise GeoError("a pattern has nine of T, F, *, 0, 1 and 2")
    return F.regexp_like(relate(a, b), F.lit("^" + "".join({"T": "[012]", "*": "."}.get(c, c) for c in pattern) + "$"))


def relate_boolean(a: Geo, b: Geo, f: Callable[[str], bool]) -> Column:
    """f of the matrix, row by row."""
    check_same(a, b)
    return _call(lambda x, y: bool(f(arrange.relate(x, y))), T.BooleanType(), [a, b])


def is_valid(g: Geo) -> Column:
    return _call(lambda x: planar.invalid_reason(x) == planar.VALID, T.BooleanType(), [g])


def is_valid_reason(g: Geo) -> Column:
    """"Valid Geometry", or which rule is broken."""
    return _call(planar.invalid_reason, T.StringType(), [g])


def is_simple(g: Geo) -> Column:
    return _call(planar.is_simple, T.BooleanType(), [g])


def is_ring(g: Geo) -> Column:
    """A closed line that does not meet itself. Native lines that are not closed are settled by an expression."""
    if g.type.kind == "linestring":
        from tessera.functions import native

        closed = native.is_closed(g)
        return F.when(closed, _call(planar.is_ring, T.BooleanType(), [Geo(F.when(closed, g.column), g.type)])).otherwise(closed)
    return _call(planar.is_ring, T.BooleanType(), [g])


def is_empty(g: Geo) -> Column:
    return _call(codecs.is_empty, T.BooleanType(), [g])


# measures


def euclidean_distance(a: Geo, b: Geo) -> Column:
    """Between any kinds; 0 if they meet; null if one is empty."""
    check_same(a, b)
    return _call(planar.distance, T.DoubleType(), [a, b])


def frechet_distance(a: Geo, b: Geo) -> Column:
    check_same(a, b)
    return _call(planar.frechet_distance, T.DoubleType(), [a, b])


#: Lists that lines nest.
_PATHS = {"linestring": 1, "multilinestring": 2}


def _lengths(g: Geo, over_antipodes: bool) -> Callable[..., pa.Array | None] | None:
    depth = _PATHS.get(g.type.kind)
    return (lambda a: geodesic.lengths(a, depth, over_antipodes)) if depth else None


def geodesic_length(g: Geo) -> Column:
    return _call(geodesic.geodesic_length, T.DoubleType(), [g], fast=_lengths(g, True))


def vincenty_length(g: Geo) -> Column:
    return _call(geodesic.vincenty_length, T.DoubleType(), [g], fast=_lengths(g, False))


def geodesic_perimeter(g: Geo) -> Column:
    return _call(lambda x: geodesic.geodesic(x)[0], T.DoubleType(), [g])


def geodesic_signed_area(g: Geo) -> Column:
    return _call(lambda x: geodesic.geodesic(x)[1], T.DoubleType(), [g])


def geodesic_unsigned_area(g: Geo) -> Column:
    return _call(lambda x: geodesic.geodesic(x)[2], T.DoubleType(), [g])


_BOTH = T.StructType([T.StructField("perimeter", T.DoubleType()), T.StructField("area", T.DoubleType())])


def geodesic_perimeter_area_signed(g: Geo) -> Column:
    return _call(lambda x: dict(zip(("perimeter", "area"), geodesic.geodesic(x)[:2], strict=True)), _BOTH, [g])


def geodesic_perimeter_area_unsigned(g: Geo) -> Column:
    return _call(lambda x: dict(zip(("perimeter", "area"), geodesic.geodesic(x)[::2], strict=True)), _BOTH, [g])


# constructive


def convex_hull(g: Geo) -> Geo:
    t = _xy(g.type, "polygon")
    return Geo(_call(planar.convex_hull, t, [g]), t)


def concave_hull(g: Geo, concavity: float | Column = 2.0) -> Geo:
    t = _xy(g.type, "polygon")
    return Geo(_call(planar.concave_hull, t, [g], [_number(concavity)]), t)


def minimum_rotated_rect(g: Geo) -> Geo:
    t = _xy(g.type, "polygon")
    return Geo(_call(planar.minimum_rotated_rect, t, [g]), t)


def interior_point(g: Geo) -> Geo:
    t = _xy(g.type, "point")
    return Geo(_call(planar.interior_point, t, [g]), t)


def polylabel(g: Geo, tolerance: float) -> Geo:
    if g.type.kind not in ("polygon", "wkb", "geometry"):
        raise GeoError("polylabel is for polygons")
    t = _xy(g.type, "point")
    return Geo(_call(planar.polylabel, t, [g], [_number(tolerance)]), t)


def buffer(g: Geo, distance: float | Column, quadrant_segments: int = 8, cap: str = "round", join: str = "round", mitre_limit: float = 5.0) -> Geo:
    """A multipolygon in x and y. cap: round, flat or square; join: round, mitre or bevel."""
    if cap not in planar.CAPS or join not in planar.JOINS:
        raise GeoError(f"no such cap or join: {cap}, {join}")
    t = _xy(g.type, "multipolygon")
    return Geo(_call(lambda x, d: planar.buffer(x, d, quadrant_segments, cap, join, mitre_limit), t, [g], [_number(distance)]), t)


def _simplified(f: Callable[[G, float], G], g: Geo, epsilon: float | Column) -> Geo:
    if g.type.kind in ("point", "multipoint", "box", "geometrycollection"):
        return g
    t = g.type if g.type.native else replace(g.type, kind="geometry")
    return Geo(_call(f, t, [g], [_number(epsilon)]), t)


def simplify(g: Geo, epsilon: float | Column) -> Geo:
    return _simplified(planar.simplify, g, epsilon)


def simplify_vw(g: Geo, epsilon: float | Column) -> Geo:
    return _simplified(planar.simplify_vw, g, epsilon)


def simplify_vw_preserve(g: Geo, epsilon: float | Column) -> Geo:
    return _simplified(planar.simplify_vw_preserve, g, epsilon)


def _overlay(op: str) -> Callable[[Geo, Geo], Geo]:
    def f(a: Geo, b: Geo) -> Geo:
        check_same(a, b)
        t = replace(a.type, kind="geometry", dim="xy")
        return Geo(_call(lambda x, y: arrange.overlay(x, y, op), t, [a, b]), t)

    f.__name__, f.__doc__ = op, f"The {op.replace('_', ' ')} of two geometries as a mixed column."
    return f


intersection, union, difference, sym_difference = map(_overlay, ("intersection", "union", "difference", "sym_difference"))


def as_svg(g: Geo) -> Column:
    """SVG elements: circles, polylines and paths, multi-part kinds in a group; y grows downwards, as the numbers are."""
    return _call(codecs.to_svg, T.StringType(), [g])


# user functions


def map_chunks(f: Callable[[list[G | None]], list], out: T.DataType | GeoType, g: Geo) -> Column | Geo:
    """f of whole batches of geometries, nulls among them; it gives as many values. For what is cheaper for many rows at once."""

    t = g.type

    def run(a: pa.Array) -> pa.Array:
        rows = f(decode(a, t))
        if len(rows) != len(a):
            raise GeoError(f"{len(rows)} values for {len(a)} geometries")
        return encode(rows, out) if isinstance(out, GeoType) else pa.array(rows, to_arrow_type(out))

    c = F.arrow_udf(run, out.storage if isinstance(out, GeoType) else out)(g.column)
    return Geo(c, out) if isinstance(out, GeoType) else c


def unary(f: Callable[[G], Any], out: T.DataType | GeoType, g: Geo) -> Column | Geo:
    """f of each geometry; NULL stays NULL. out: a Spark type, or a geometry type if f gives geometries."""
    c = _call(f, out, [g])
    return Geo(c, out) if isinstance(out, GeoType) else c


def binary(f: Callable[[G, G], Any], out: T.DataType | GeoType, a: Geo, b: Geo) -> Column | Geo:
    check_same(a, b)
    c = _call(f, out, [a, b])
    return Geo(c, out) if isinstance(out, GeoType) else c


