"""Functions on native geometry columns as Column expressions: they stay in the JVM.

NULL gives NULL. Only x and y count unless said otherwise. Kinds that a
function does not concern give its neutral value (an area of 0 for lines),
decided when the expression is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import DEPTH, Geo, GeoError, GeoType, box, check_same

#: Mean radius of the earth in metres for great circles; equatorial radius.
EARTH_RADIUS, EQUATOR_RADIUS = 6_371_008.8, 6_378_137.0
_NAN = float("nan")
Number = float | Column


def _native(g: Geo, *kinds: str) -> Geo:
    if not g.type.native or (kinds and g.type.kind not in kinds):
        raise GeoError(f"{g.type.kind} columns are not supported here" + (f"; use {', '.join(kinds)}" if kinds else ""))
    return g


def _real(p: Column) -> Column:
    return ~(F.isnan(p["x"]) & F.isnan(p["y"]))


def make_point(x: Number, y: Number, z: Number | None = None, m: Number | None = None, **reference) -> Geo:
    """A point column from numbers; null if one is null."""
    parts = [(a, c) for a, c in (("x", x), ("y", y), ("z", z), ("m", m)) if c is not None]
    cols = [(F.lit(c) if not isinstance(c, Column) else c).cast("double") for _, c in parts]
    ok = cols[0].isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    return Geo(F.when(ok, F.struct(*[c.alias(a) for (a, _), c in zip(parts, cols, strict=True)])), GeoType("point", "".join(a for a, _ in parts), **reference))


def make_geometry(kind: str, vertices: Column, dim: str = "xy", **reference) -> Geo:
    """A column of nested arrays of vertex structs as a geometry."""
    t = GeoType(kind, dim, **reference)
    return Geo(vertices.cast(t.storage), t)


def make_box(xmin: Number, ymin: Number, xmax: Number, ymax: Number) -> Geo:
    c = [(F.lit(v) if not isinstance(v, Column) else v).cast("double").alias(n) for v, n in zip((xmin, ymin, xmax, ymax), ("xmin", "ymin", "xmax", "ymax"), strict=True)]
    return Geo(F.struct(*c), box())


def box_to_polygon(b: Geo) -> Geo:
    """The ring of a box, counter-clockwise from its lowest corner."""
    c, p = b.column, lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(c["xmin"], c["ymin"]), p(c["xmax"], c["ymin"]), p(c["xmax"], c["ymax"]), p(c["xmin"], c["ymax"]), p(c["xmin"], c["ymin"]))
    return Geo(F.when(c.isNotNull(), F.array(ring)), GeoType("polygon", "xy", b.type.crs, b.type.crs_form, b.type.edges))


def _each(items: Column, constant: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each item and a constant that is computed once. The constant goes along with the items: Spark takes no Python function out of an expression whose inner lambdas use variables of outer ones."""
    return F.zip_with(items, F.array_repeat(constant, F.greatest(F.size(items), F.lit(0))), f)


def paths(g: Geo) -> Column:
    """array<array<vertex>>: the lines and rings; each point is a path of its own. An empty point has none."""
    c, kind = _native(g).column, g.type.kind
    if kind == "point":
        return F.when(c.isNotNull(), F.filter(F.array(F.array(c)), lambda a: _real(a[0])))
    if kind == "multipoint":
        return F.transform(c, lambda p: F.array(p))
    if kind == "linestring":
        return F.when(c.isNotNull(), F.array(c))
    return F.flatten(c) if kind == "multipolygon" else c


def coords(g: Geo) -> Column:
    """array<vertex>: all vertices."""
    return g.column if _native(g).type.kind in ("linestring", "multipoint") else F.flatten(paths(g))


def _steps(path: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each vertex and the next, as an array."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n), f)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _sum_paths(g: Geo, f: Callable[[Column], Column]) -> Column:
    return _total(F.transform(paths(g), f))


def _zero(g: Geo) -> Column:
    return F.when(g.column.isNotNull(), F.lit(0.0))


# measures


def _ring_area(ring: Column) -> Column:
    """Signed, counter-clockwise positive; coordinates relative to the first vertex."""
    o = F.get(ring, F.lit(0))
    return _total(_steps(ring, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))) / 2.0


def _with_holes(rings: Column, ring_area: Callable[[Column], Column]) -> Column:
    """The shell's area without the holes', with the shell's sign; 0 without rings."""
    areas = F.transform(rings, ring_area)
    shell = F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0))
    holes = _total(F.transform(F.slice(areas, F.lit(2), F.greatest(F.size(areas) - 1, F.lit(0))), F.abs))
    return F.when(shell < 0, shell + holes).otherwise(shell - holes)


def _polygon_area(g: Geo, ring_area: Callable[[Column], Column], each: Callable[[Column], Column]) -> Column:
    if g.type.kind == "polygon":
        return each(_with_holes(g.column, ring_area))
    if g.type.kind == "multipolygon":
        return _total(F.transform(g.column, lambda p: each(_with_holes(p, ring_area))))
    return _zero(g)


def signed_area(g: Geo) -> Column:
    if g.type.kind == "box":
        return (g.column["xmax"] - g.column["xmin"]) * (g.column["ymax"] - g.column["ymin"])
    return _polygon_area(_native(g), _ring_area, lambda a: a)


def unsigned_area(g: Geo) -> Column:
    if g.type.kind == "box":
        return F.abs(signed_area(g))
    return _polygon_area(_native(g), _ring_area, F.abs)


def _spherical_ring(ring: Column) -> Column:
    """Chamberlain and Duquette's formula on a sphere of the equatorial radius."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    after = F.concat(F.slice(ring, F.lit(3), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.least(n, F.lit(1))))
    ends = F.zip_with(F.slice(ring, F.lit(1), n), after, lambda a, c: F.radians(c["x"]) - F.radians(a["x"]))
    terms = F.zip_with(ends, F.slice(ring, F.lit(2), n), lambda d, b: d * F.sin(F.radians(b["y"])))
    return _total(terms) * (EQUATOR_RADIUS * EQUATOR_RADIUS / -2.0)


def chamberlain_duquette_signed_area(g: Geo) -> Column:
    return _polygon_area(_native(g), _spherical_ring, lambda a: a)


def chamberlain_duquette_unsigned_area(g: Geo) -> Column:
    return _polygon_area(_native(g), _spherical_ring, F.abs)


def _distance(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def _haversine(a: Column, b: Column) -> Column:
    dy, dx = F.radians(b["y"] - a["y"]) / 2.0, F.radians(b["x"] - a["x"]) / 2.0
    h = F.sin(dy) * F.sin(dy) + F.cos(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * F.sin(dx) * F.sin(dx)
    return 2.0 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _line_length(g: Geo, step: Callable[[Column, Column], Column]) -> Column:
    if _native(g).type.kind in ("linestring", "multilinestring"):
        return _sum_paths(g, lambda p: _total(_steps(p, step)))
    return _zero(g)


def euclidean_length(g: Geo) -> Column:
    """Of lines; 0 for all other kinds, polygons too."""
    return _line_length(g, _distance)


def perimeter(g: Geo) -> Column:
    """The length of lines and of rings."""
    return _sum_paths(_native(g), lambda p: _total(_steps(p, _distance)))


def haversine_length(g: Geo) -> Column:
    """In metres, along great circles, of lines in degrees."""
    return _line_length(g, _haversine)


def point_distance(a: Geo, b: Geo) -> Column:
    check_same(_native(a, "point"), _native(b, "point"))
    return _distance(a.column, b.column)


def haversine_distance(a: Geo, b: Geo) -> Column:
    check_same(_native(a, "point"), _native(b, "point"))
    return _haversine(a.column, b.column)


def line_locate_point(line: Geo, p: Geo) -> Column:
    """Share of the line's length, 0 to 1, up to its nearest place; 0 for lines without length; null if coordinates are not finite."""
    check_same(_native(line, "linestring"), _native(p, "point"))
    q = p.column

    def at(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = dx * dx + dy * dy
        t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((q["x"] - a["x"]) * dx + (q["y"] - a["y"]) * dy) / n)))
        ex, ey = a["x"] + t * dx - q["x"], a["y"] + t * dy - q["y"]
        return F.struct(F.sqrt(n).alias("n"), t.alias("t"), (ex * ex + ey * ey).alias("d"))

    start = F.struct(F.lit(0.0).alias("done"), F.lit(math.inf).alias("d"), F.lit(0.0).alias("at"))
    share = F.aggregate(
        _steps(line.column, at),
        start,
        lambda s, v: F.struct((s["done"] + v["n"]).alias("done"), F.least(s["d"], v["d"]).alias("d"), F.when(v["d"] < s["d"], s["done"] + v["t"] * v["n"]).otherwise(s["at"]).alias("at")),
        lambda s: F.when(s["done"] == 0, F.lit(0.0)).otherwise(s["at"] / s["done"]),
    )
    ok = lambda v: (F.abs(v["x"]) < math.inf) & (F.abs(v["y"]) < math.inf)
    finite = F.forall(line.column, ok) & ok(q)
    return F.when(finite & (F.size(line.column) > 0), share)


# predicates


def is_empty(g: Geo) -> Column:
    """Without vertices. Points and boxes are never empty here, as in the row-wise kernels they come from."""
    if g.type.kind in ("point", "box"):
        return F.when(g.column.isNotNull(), F.lit(False))
    return F.size(coords(g)) == 0


def is_closed(g: Geo) -> Column:
    """A line of at least four vertices that ends where it starts. Whether it is a ring: kernel.is_ring."""
    c = _native(g, "linestring").column
    return F.when(c.isNotNull(), (F.size(c) >= 4) & (F.get(c, F.lit(0)) == F.get(c, F.size(c) - 1)))


def geometry_equals(a: Geo, b: Geo) -> Column:
    """The same vertices in the same order, in all dimensions. Null if one is null; False for different kinds."""
    if (a.type.kind, a.type.dim) != (b.type.kind, b.type.dim):
        return F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(False))
    return a.column == b.column


def equals_exact(a: Geo, b: Geo, tolerance: float) -> Column:
    """The same structure, with x and y of each vertex at most tolerance apart."""
    if a.type.kind != b.type.kind:
        return F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(False))

    def near(x: Column, y: Column, depth: int) -> Column:
        if not depth:
            return (F.abs(x["x"] - y["x"]) <= tolerance) & (F.abs(x["y"] - y["y"]) <= tolerance)
        return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: F.coalesce(near(p, q, depth - 1), F.lit(False))), lambda v: v)

    return near(_native(a).column, _native(b).column, DEPTH[a.type.kind])


def _bounds(g: Geo) -> Column:
    return g.column if g.type.kind == "box" else bounding_rect(g).column


def bbox_intersects(a: Geo, b: Geo) -> Column:
    """Closed boxes overlap or touch; null if one has none."""
    p, q = _bounds(a), _bounds(b)
    return (p["xmax"] >= q["xmin"]) & (p["ymax"] >= q["ymin"]) & (p["xmin"] <= q["xmax"]) & (p["ymin"] <= q["ymax"])


#: What a vertex on the boundary adds to the number of crossings.
_ON = 1_000_000


def _crossing(a: Column, b: Column, p: Column) -> Column:
    """_ON if p is on the edge, 1 if a ray from p to the right crosses it, else 0. Most edges are settled by comparisons."""
    ends = (a["y"] > p["y"]) != (b["y"] > p["y"])
    side = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    off = ((p["y"] < a["y"]) & (p["y"] < b["y"])) | ((p["y"] > a["y"]) & (p["y"] > b["y"])) | ((p["x"] > a["x"]) & (p["x"] > b["x"]))
    left = (p["x"] < a["x"]) & (p["x"] < b["x"])
    return F.when(off, 0).when(left, F.when(ends, 1).otherwise(0)).when(side == 0, _ON).when(ends & ((side > 0) == (b["y"] > a["y"])), 1).otherwise(0)


def _located(area: Geo, p: Column, test: Callable[[Column], Column]) -> Column:
    """test of the sum of crossings over all rings."""
    return F.aggregate(F.flatten(F.transform(paths(area), lambda r: _steps(r, lambda a, b: _crossing(a, b, p)))), F.lit(0), lambda t, v: t + v, test)


def polygon_contains_point(area: Geo, p: Geo) -> Column:
    """Inside, not on the boundary."""
    check_same(_native(area, "polygon", "multipolygon"), _native(p, "point"))
    return F.when(area.column.isNotNull() & p.column.isNotNull(), _located(area, p.column, lambda t: (t < _ON) & (t % 2 == 1)))


def polygon_intersects_point(area: Geo, p: Geo) -> Column:
    """Inside or on the boundary."""
    check_same(_native(area, "polygon", "multipolygon"), _native(p, "point"))
    return F.when(area.column.isNotNull() & p.column.isNotNull(), _located(area, p.column, lambda t: (t >= _ON) | (t % 2 == 1)))


def type_id(g: Geo) -> Column:
    """Ten times the dimension's place plus the kind's code; boxes count as polygons. Of WKB from its first bytes."""
    if g.type.type_id is not None:
        return F.when(g.column.isNotNull(), F.lit(g.type.type_id)).cast("tinyint")
    if g.type.kind == "wkt":
        raise GeoError("decode WKT first")
    h = F.hex(F.substring(g.column, 1, 5))
    byte = lambda k: F.substring(h, 2 * k + 1, 2)
    code = F.conv(F.when(byte(0) == "01", F.concat(byte(4), byte(3), byte(2), byte(1))).otherwise(F.concat(byte(1), byte(2), byte(3), byte(4))), 16, 10).cast("long")
    plain = code.bitwiseAND(F.lit(0x0FFFFFFF))
    dims = F.floor(plain / 1000) + F.when(code.bitwiseAND(F.lit(0x80000000)) != 0, 1).otherwise(0) + F.when(code.bitwiseAND(F.lit(0x40000000)) != 0, 2).otherwise(0)
    return (dims * 10 + plain % 1000).cast("tinyint")


def type_id_other_numbering(g: Geo) -> Column:
    """0 point, 1 line, 3 polygon, 4 to 6 their multi-part forms, 7 collection; -1 for null; dimensions do not count."""
    code = type_id(g) % 10
    return F.when(code.isNull(), F.lit(-1)).when(code <= 2, code - 1).otherwise(code).cast("smallint")


# constructive


def _with(g: Geo, column: Column, kind: str | None = None, dim: str | None = None) -> Geo:
    return Geo(column, replace(g.type, kind=kind or g.type.kind, dim=dim or g.type.dim))


def bounding_rect(g: Geo) -> Geo:
    """The box of x and y; null for null and empty geometries. The antimeridian is a line like others."""
    if g.type.kind == "box":
        return g
    if g.type.kind == "point":
        c = g.column
        return _with(g, F.when(c.isNotNull() & _real(c), F.struct(c["x"].alias("xmin"), c["y"].alias("ymin"), c["x"].alias("xmax"), c["y"].alias("ymax"))), "box", "xy")
    vs = coords(g)
    lo = lambda a: F.array_min(F.transform(vs, lambda p: p[a]))
    hi = lambda a: F.array_max(F.transform(vs, lambda p: p[a]))
    return _with(g, F.when(F.size(vs) > 0, F.struct(lo("x").alias("xmin"), lo("y").alias("ymin"), hi("x").alias("xmax"), hi("y").alias("ymax"))), "box", "xy")


def center(g: Geo) -> Geo:
    """The middle of the bounding box; null without one."""
    b = _bounds(g)
    return _with(g, F.when(b.isNotNull(), F.struct(((b["xmin"] + b["xmax"]) / 2.0).alias("x"), ((b["ymin"] + b["ymax"]) / 2.0).alias("y"))), "point", "xy")


def _sums(values: Column, finish: Callable[[Column], Column] | None = None) -> Column:
    """Sums of structs (w, x, y), through finish if there is one."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(values, zero, lambda s, v: F.struct((s["w"] + v["w"]).alias("w"), (s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y")), finish)


def _weighted(w: Column, x: Column, y: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"))


def centroid(g: Geo) -> Geo:
    """Of areas; of lines where there is no area; of vertices where there is no length. Null for null and empty."""
    # each sum gives its place or null, so that it is computed once, and vertices' only where there is no length
    place = lambda s: F.struct((s["x"] / s["w"]).alias("x"), (s["y"] / s["w"]).alias("y"))
    best = [_sums(F.transform(F.filter(coords(g), _real), lambda p: _weighted(F.lit(1.0), p["x"], p["y"])), place)]
    if g.type.kind not in ("point", "multipoint"):

        def along(a: Column, b: Column) -> Column:
            n = _distance(a, b)
            return _weighted(n, n * (a["x"] + b["x"]) / 2.0, n * (a["y"] + b["y"]) / 2.0)

        legs = _steps(g.column, along) if g.type.kind == "linestring" else F.flatten(F.transform(paths(g), lambda r: _steps(r, along)))
        best = [_sums(legs, lambda s: F.when(s["w"] > 0, place(s))), *best]
        if g.type.kind in ("polygon", "multipolygon"):

            def ring(r: Column) -> Column:
                o = F.get(r, F.lit(0))

                def step(s: Column, o: Column) -> Column:
                    a, b = s["a"], s["b"]
                    k = (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
                    return _weighted(k, (a["x"] + b["x"] - 2.0 * o["x"]) * k, (a["y"] + b["y"] - 2.0 * o["y"]) * k)

                s = _sums(_each(_steps(r, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), o, step))
                # area, and area times centroid, with the sign taken off
                sign = F.when(s["w"] < 0, -1.0).otherwise(1.0)
                return _weighted(sign * s["w"] / 2.0, sign * (s["x"] / 6.0 + s["w"] / 2.0 * o["x"]), sign * (s["y"] / 6.0 + s["w"] / 2.0 * o["y"]))

            def area(rings: Column, finish: Callable[[Column], Column] | None = None) -> Column:
                parts = F.transform(rings, ring)
                return _sums(F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(_weighted(-s["w"], -s["x"], -s["y"]))), finish)

            middle = lambda s: F.when(s["w"] != 0, place(s))
            best = [area(g.column, middle) if g.type.kind == "polygon" else _sums(F.transform(g.column, area), middle), *best]
    return _with(g, F.when(F.exists(coords(g), _real), F.coalesce(*best)), "point", "xy")


def map_coords(g: Geo, f: Callable[[Column], dict[str, Column]]) -> Geo:
    """Each vertex through f, which gives new columns for some axes; the others stay."""
    _native(g)

    def one(p: Column) -> Column:
        new = f(p)
        return F.struct(*[new.get(a, p[a]).cast("double").alias(a) for a in g.type.dim])

    def walk(c: Column, depth: int) -> Column:
        return F.transform(c, lambda x: walk(x, depth - 1)) if depth else one(c)

    out = walk(g.column, DEPTH[g.type.kind])  # of a null array: null
    return _with(g, out if DEPTH[g.type.kind] else F.when(g.column.isNotNull(), out))


def affine_transform(g: Geo, matrix: tuple[Number, ...]) -> Geo:
    """x' = a x + b y + c, y' = d x + e y + f for (a, b, c, d, e, f); nine numbers: a matrix whose last row is 0 0 1. Numbers or columns."""
    if len(matrix) == 9:
        matrix = matrix[:6]
    a, b, c, d, e, f = ((F.lit(float(v)) if not isinstance(v, Column) else v) for v in matrix)
    return map_coords(g, lambda p: {"x": a * p["x"] + b * p["y"] + c, "y": d * p["x"] + e * p["y"] + f})


def translate(g: Geo, dx: Number, dy: Number) -> Geo:
    return map_coords(g, lambda p: {"x": p["x"] + dx, "y": p["y"] + dy})


def _origin(g: Geo, origin: str | tuple[Number, Number] | Geo) -> tuple[Column, Column]:
    if isinstance(origin, str):
        c = {"center": center, "centroid": centroid}[origin](g).column
        return c["x"], c["y"]  # the same expression twice: evaluated once for both
    if isinstance(origin, Geo):
        return origin.column["x"], origin.column["y"]
    return tuple((F.lit(float(v)) if not isinstance(v, Column) else v) for v in origin)


def _about(g: Geo, constants: list[Column], f: Callable[[Column, Column], dict[str, Column]]) -> Geo:
    """map_coords whose map uses constants of the row: a struct of c0, c1 and so on."""
    bound = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(constants)])

    def one(p: Column, c: Column) -> Column:
        new = f(p, c)
        return F.struct(*[new.get(a, p[a]).cast("double").alias(a) for a in g.type.dim])

    def walk(v: Column, c: Column, depth: int) -> Column:
        return _each(v, c, lambda x, k: walk(x, k, depth - 1)) if depth else one(v, c)

    depth = DEPTH[_native(g).type.kind]
    out = walk(g.column, bound, depth)
    return _with(g, out if depth else F.when(g.column.isNotNull(), out))


def rotate(g: Geo, degrees: Number, origin: str | tuple[Number, Number] | Geo = "center") -> Geo:
    """Counter-clockwise about the bounding box's center, the centroid or a point."""
    t = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))

    def turned(p: Column, c: Column) -> dict[str, Column]:
        dx, dy = p["x"] - c["c0"], p["y"] - c["c1"]
        return {"x": c["c0"] + dx * c["c2"] - dy * c["c3"], "y": c["c1"] + dx * c["c3"] + dy * c["c2"]}

    return _about(g, [*_origin(g, origin), F.cos(t), F.sin(t)], turned)


def scale(g: Geo, x_factor: Number, y_factor: Number | None = None, origin: str | tuple[Number, Number] | Geo = "center") -> Geo:
    y_factor = x_factor if y_factor is None else y_factor
    return _about(g, [*_origin(g, origin)], lambda p, c: {"x": c["c0"] + (p["x"] - c["c0"]) * x_factor, "y": c["c1"] + (p["y"] - c["c1"]) * y_factor})


def skew(g: Geo, x_degrees: Number, y_degrees: Number | None = None, origin: str | tuple[Number, Number] | Geo = "center") -> Geo:
    y_degrees = x_degrees if y_degrees is None else y_degrees
    tangents = [F.tan(F.radians(v if isinstance(v, Column) else F.lit(float(v)))) for v in (x_degrees, y_degrees)]
    return _about(g, [*_origin(g, origin), *tangents], lambda p, c: {"x": p["x"] + (p["y"] - c["c1"]) * c["c2"], "y": p["y"] + (p["x"] - c["c0"]) * c["c3"]})


def _map_paths(g: Geo, f: Callable[[Column], Column]) -> Geo:
    """Each line and ring through f; points and multipoints stay."""
    depth = DEPTH[_native(g).type.kind]
    if g.type.kind in ("point", "multipoint"):
        return g

    def walk(c: Column, d: int) -> Column:
        return F.transform(c, lambda x: walk(x, d - 1)) if d > 1 else f(c)

    return _with(g, F.when(g.column.isNotNull(), walk(g.column, depth)))


def _between(g: Geo, a: Column, b: Column, t: Column | float) -> Column:
    return F.struct(*[(a[k] + (b[k] - a[k]) * t).alias(k) for k in g.type.dim])


def densify(g: Geo, max_distance: float) -> Geo:
    """Vertices added so that none is farther than max_distance from the next."""
    if not max_distance > 0:
        raise GeoError("max_distance must be over 0")

    def steps(a: Column, b: Column) -> Column:
        n = F.greatest(F.ceil(_distance(a, b) / max_distance), F.lit(1)).cast("int")
        # one leg, with what its vertices have in common, as often as it has vertices
        leg = F.struct(*[x.alias(f"{k}{name}") for k in g.type.dim for name, x in (("0", a[k]), ("1", b[k] - a[k]))], n.cast("double").alias("n"))
        at = lambda s, t: F.struct(*[(s[f"{k}0"] + s[f"{k}1"] * t).alias(k) for k in g.type.dim])
        first = lambda s: F.struct(*[s[f"{k}0"].alias(k) for k in g.type.dim])
        return F.transform(F.array_repeat(leg, n), lambda s, i: F.when(i == 0, first(s)).otherwise(at(s, i / s["n"])))

    return _map_paths(g, lambda r: F.concat(F.flatten(_steps(r, steps)), F.slice(r, F.greatest(F.size(r), F.lit(1)), F.lit(1))))


def chaikin_smoothing(g: Geo, iterations: int) -> Geo:
    """Corners cut at a quarter and three quarters. Open lines keep their ends, closed ones are smoothed all round."""

    def once(r: Column) -> Column:
        cut = F.flatten(_steps(r, lambda a, b: F.array(_between(g, a, b, 0.25), _between(g, a, b, 0.75))))
        first, last = F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)
        closed = F.concat(cut, F.slice(cut, F.lit(1), F.lit(1)))
        return F.when(F.size(r) < 3, r).when(first == last, closed).otherwise(F.concat(F.array(first), cut, F.array(last)))

    empty = T.ArrayType(T.StructType([T.StructField(a, T.DoubleType()) for a in g.type.dim]))
    if iterations <= 0:
        return g
    return _map_paths(g, lambda r: F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), r.cast(empty), lambda acc, _: once(acc).cast(empty)))


def remove_repeated_points(g: Geo) -> Geo:
    """Of vertices that follow each other and are equal the first stays; of a multipoint's equal points, wherever they are."""
    if g.type.kind == "multipoint":
        return _with(g, F.array_distinct(g.column))

    def once(r: Column) -> Column:
        # each vertex with the one before; the first has itself
        n = F.greatest(F.size(r), F.lit(1))
        before = F.concat(F.slice(r, F.lit(1), F.lit(1)), F.slice(r, F.lit(1), n - 1))
        pairs = F.zip_with(r, before, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        return F.transform(F.filter(pairs, lambda s, i: (i == 0) | (s["p"] != s["q"])), lambda s: s["p"])

    return _map_paths(g, once)


def line_interpolate_point(line: Geo, fraction: Number) -> Geo:
    """The place at a share of the length; below 0 the start, over 1 the end; null for NaN and lines without vertices."""
    c = _native(line, "linestring").column
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    place = T.StructType([T.StructField(a, T.DoubleType()) for a in line.type.dim])
    legs = _steps(c, lambda a, b: F.struct(a.alias("a"), b.alias("b"), _distance(a, b).alias("n")))
    goal = euclidean_length(line) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))
    start = F.struct(goal.alias("goal"), F.lit(0.0).alias("done"), F.lit(None).cast(place).alias("at"))

    def step(s: Column, v: Column) -> Column:
        here = F.when(s["at"].isNotNull(), s["at"]).when((v["n"] > 0) & (s["done"] + v["n"] >= s["goal"]), _between(line, v["a"], v["b"], (s["goal"] - s["done"]) / v["n"]))
        return F.struct(s["goal"].alias("goal"), (s["done"] + v["n"]).alias("done"), here.cast(place).alias("at"))

    walk = F.aggregate(legs, start, step, lambda s: s["at"])
    last = F.get(c, F.size(c) - 1)
    out = F.when(f >= 1, last).when(f <= 0, F.get(c, F.lit(0))).otherwise(F.coalesce(walk, last))
    return _with(line, F.when(~F.isnan(f) & (F.size(c) > 0), out), "point")


#: Half the circumference of the projected square of web maps, in metres; its latitude limit is where y equals it.
WEB_MERCATOR = math.pi * EQUATOR_RADIUS


#: The ellipsoid WGS 84: flattening and third flattening; scale on a zone's meridian; its easting; the northing of the equator in the south.
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_K0, _EAST, _SOUTH = 0.9996, 500_000.0, 10_000_000.0
#: Krueger's series in the third flattening to the sixth power, from the conformal sphere to the plane and back.
_POWERS = [_N**k for k in range(7)]
_RADIUS = EQUATOR_RADIUS / (1 + _N) * (1 + _POWERS[2] / 4 + _POWERS[4] / 64 + _POWERS[6] / 256)
_series = lambda rows: [sum(c * _POWERS[k + j + 1] for k, c in enumerate(row)) for j, row in enumerate(rows)]
_TO_PLANE = _series((
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,),
))
_TO_SPHERE = _series((
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,),
))


def utm_zone(crs: str) -> tuple[int, bool] | None:
    """Zone and whether it is in the south, of EPSG codes 32601 to 32660 and 32701 to 32760."""
    code = crs.removeprefix("EPSG:")
    ok = code.isdigit() and len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60
    return (int(code[3:]), code[2] == "7") if ok else None


def _conformal(tau: Column) -> Column:
    """The tangent of the conformal latitude from that of the latitude."""
    e = math.sqrt(_F * (2 - _F))
    root = F.sqrt(1 + tau * tau)
    sigma = F.sinh(e * F.atanh(e * tau / root))
    return tau * F.sqrt(1 + sigma * sigma) - sigma * root


def _to_utm(zone: int, south: bool) -> list[Callable[[Column], dict[str, Column]]]:
    """Steps from degrees to metres: angle from the meridian and conformal latitude, the sphere's transverse plane, the ellipsoid's."""

    def plane(p: Column) -> dict[str, Column]:
        return {"x": F.asinh(F.sin(p["x"]) / F.sqrt(p["y"] * p["y"] + F.cos(p["x"]) * F.cos(p["x"]))), "y": F.atan2(p["y"], F.cos(p["x"]))}

    def metres(p: Column) -> dict[str, Column]:
        east, north = p["x"], p["y"]
        for k, a in enumerate(_TO_PLANE, 1):
            east, north = east + a * F.cos(2 * k * p["y"]) * F.sinh(2 * k * p["x"]), north + a * F.sin(2 * k * p["y"]) * F.cosh(2 * k * p["x"])
        return {"x": _EAST + _K0 * _RADIUS * east, "y": (_SOUTH if south else 0.0) + _K0 * _RADIUS * north}

    return [lambda p: {"x": F.radians(p["x"] - (6 * zone - 183)), "y": _conformal(F.tan(F.radians(p["y"])))}, plane, metres]


def _from_utm(zone: int, south: bool) -> list[Callable[[Column], dict[str, Column]]]:
    e2 = _F * (2 - _F)

    def sphere(p: Column) -> dict[str, Column]:
        eta, xi = p["x"], p["y"]
        for k, b in enumerate(_TO_SPHERE, 1):
            eta, xi = eta - b * F.cos(2 * k * p["y"]) * F.sinh(2 * k * p["x"]), xi - b * F.sin(2 * k * p["y"]) * F.cosh(2 * k * p["x"])
        return {"x": eta, "y": xi}

    def nearer(tau: Column, t: Column) -> Column:
        """A step of Newton's method."""
        now = _conformal(tau)
        return tau + (t - now) / F.sqrt(1 + now * now) * (1 + (1 - e2) * tau * tau) / ((1 - e2) * F.sqrt(1 + tau * tau))

    return [
        lambda p: {"x": (p["x"] - _EAST) / (_K0 * _RADIUS), "y": (p["y"] - (_SOUTH if south else 0.0)) / (_K0 * _RADIUS)},
        sphere,
        lambda p: {"x": F.atan2(F.sinh(p["x"]), F.cos(p["y"])), "y": F.sin(p["y"]) / F.sqrt(F.sinh(p["x"]) * F.sinh(p["x"]) + F.cos(p["y"]) * F.cos(p["y"]))},
        lambda p: {"x": F.degrees(p["x"]) + (6 * zone - 183), "y": F.degrees(F.atan(F.aggregate(F.sequence(F.lit(1), F.lit(4)), p["y"], lambda now, _: nearer(now, p["y"]))))},
    ]


def _chained(steps: list[Callable[[Column], dict[str, Column]]]) -> Callable[[Column], dict[str, Column]]:
    """One step after another; each names what the one before gives, so that it is computed once."""

    def bound(items: Column, step: Callable[[Column], dict[str, Column]]) -> Column:
        return F.transform(items, lambda v: F.struct(*[c.alias(a) for a, c in step(v).items()]))

    def one(p: Column) -> dict[str, Column]:
        items = F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))
        for step in steps:
            items = bound(items, step)
        at = F.get(items, F.lit(0))
        return {"x": at["x"], "y": at["y"]}

    return one


def reproject(g: Geo, source: str, target: str) -> Geo:
    """Between EPSG:4326, EPSG:3857 and the UTM zones on WGS 84 (EPSG:32601 to 32660 north, 32701 to 32760 south), from any to any; others are not supported."""
    if source == target:
        return g
    if utm_zone(source) or utm_zone(target):
        if source != "EPSG:4326" and target != "EPSG:4326":
            return reproject(reproject(g, source, "EPSG:4326"), "EPSG:4326", target)
        out = map_coords(g, _chained(_to_utm(*utm_zone(target)) if utm_zone(target) else _from_utm(*utm_zone(source))))
    elif (source, target) == ("EPSG:4326", "EPSG:3857"):
        out = map_coords(g, lambda p: {"x": F.radians(p["x"]) * EQUATOR_RADIUS, "y": F.log(F.tan(math.pi / 4 + F.radians(p["y"]) / 2)) * EQUATOR_RADIUS})
    elif (source, target) == ("EPSG:3857", "EPSG:4326"):
        out = map_coords(g, lambda p: {"x": F.degrees(p["x"] / EQUATOR_RADIUS), "y": F.degrees(2 * F.atan(F.exp(p["y"] / EQUATOR_RADIUS)) - math.pi / 2)})
    else:
        raise GeoError(f"no transformation from {source} to {target}")
    return Geo(out.column, out.type.with_crs(target, "authority_code"))


# from flat vertices


def _cut(items: Column, offsets: Column) -> Column:
    at = lambda i: F.get(offsets, i)
    cut = F.transform(F.sequence(F.lit(0), F.size(offsets) - 2), lambda i: F.slice(items, at(i) + 1, at(i + 1) - at(i)))
    return F.when(F.size(offsets) >= 2, cut).otherwise(F.filter(F.array(items), lambda _: F.lit(False)))


def from_offsets(kind: str, coords: Column, *offsets: Column) -> Column:
    """An array of geometries from an array of vertices and offsets into it, for each row.

    Points need no offsets; lines and multipoints one array (where each
    geometry starts, and the end); polygons and multilines two: where each
    geometry starts among the rings, then where each ring starts among the
    vertices; multipolygons three. Null arrays give null, fewer than two
    offsets no geometries.
    """
    if kind not in DEPTH or len(offsets) != DEPTH[kind]:
        raise GeoError(f"{kind} with {len(offsets)} arrays of offsets")
    out = coords
    for o in reversed(offsets):
        out = _cut(out, o.cast("array<int>"))
    return out


# single and multi-part


def to_multi(g: Geo) -> Geo:
    """A single-part column as its multi-part kind; an empty point has no parts."""
    kind = {"point": "multipoint", "linestring": "multilinestring", "polygon": "multipolygon"}.get(g.type.kind)
    if kind is None:
        return g
    c = F.when(g.column.isNotNull(), F.array(g.column))
    return _with(g, F.filter(c, _real) if kind == "multipoint" else c, kind)


def part_count(g: Geo) -> Column:
    if g.type.kind in ("multipoint", "multilinestring", "multipolygon"):
        return F.size(g.column)
    return F.when(g.column.isNotNull(), F.lit(1))


def to_single(g: Geo) -> Geo:
    """A multi-part column as its single-part kind. A row of several parts raises; one without parts becomes an empty geometry."""
    kind = {"multipoint": "point", "multilinestring": "linestring", "multipolygon": "polygon"}.get(g.type.kind)
    if kind is None:
        return g
    t = replace(g.type, kind=kind)
    empty = F.struct(*[F.lit(_NAN).alias(a) for a in t.dim]) if kind == "point" else F.array().cast(t.storage)
    out = F.when(F.size(g.column) > 1, F.raise_error(F.lit(f"{g.type.kind} with several parts is no {kind}")).cast(t.storage)).when(F.size(g.column) == 1, F.get(g.column, F.lit(0))).when(F.size(g.column) == 0, empty.cast(t.storage))
    return Geo(F.when(g.column.isNotNull(), out), t)


# aggregates


def total_bounds(df: DataFrame, g: Geo, *by: str) -> DataFrame:
    """xmin, ymin, xmax, ymax over all non-null rows, for each group of by; infinities (the other way round) if there are none."""
    b = _bounds(g)
    parts = [F.coalesce(f(b[k]), F.lit(v)).alias(k) for k, f, v in (("xmin", F.min, math.inf), ("ymin", F.min, math.inf), ("xmax", F.max, -math.inf), ("ymax", F.max, -math.inf))]
    return (df.groupBy(*by) if by else df).agg(*parts)


def merge_bounds(df: DataFrame, b: Geo, *by: str) -> DataFrame:
    """The box of boxes."""
    return total_bounds(df, b, *by)


def unique_type_ids(df: DataFrame, g: Geo, *by: str) -> DataFrame:
    """type_ids: the sorted distinct type ids, for each group of by."""
    return (df.groupBy(*by) if by else df).agg(F.sort_array(F.collect_set(type_id(g))).alias("type_ids"))


def counts(df: DataFrame, g: Geo, *by: str) -> DataFrame:
    """n rows and n_null of them without a geometry."""
    return (df.groupBy(*by) if by else df).agg(F.count("*").alias("n"), F.count_if(g.column.isNull()).alias("n_null"))


