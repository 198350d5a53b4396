"""Geometries as Python values, and WKB, WKT and GeoJSON of them.

A geometry is (kind, dim, value). Values nest lists of vertex tuples as the
native columns nest arrays; an empty point's value is None; a collection's is
a list of geometries.
"""

from __future__ import annotations

import json
import math
import re
import struct
from typing import Any, NamedTuple

from tessera.types import DEPTH, DIMS, KINDS, SINGLE, GeoError


class G(NamedTuple):
    kind: str
    dim: str
    value: Any


def is_empty(g: G) -> bool:
    if g.kind == "point":
        return g.value is None
    if g.kind == "geometrycollection":
        return all(is_empty(x) for x in g.value)
    return not any(True for _ in vertices(g))


def vertices(g: G):
    """All vertices, in order."""
    if g.kind == "geometrycollection":
        for x in g.value:
            yield from vertices(x)
    elif g.value is not None:
        stack = [(g.value, DEPTH[g.kind])]
        while stack:
            v, depth = stack.pop()
            if depth == 0:
                yield v
            else:
                stack += [(x, depth - 1) for x in reversed(v)]


# native columns, as Arrow gives them


def from_native(kind: str, dim: str, value: Any) -> G | None:
    """value: nested lists of dicts; a point whose coordinates are all NaN is empty."""
    if value is None:
        return None

    def walk(v, depth):
        return [walk(x, depth - 1) for x in v] if depth else tuple(v[a] for a in dim)

    if kind == "box":
        return box_polygon(value, dim)
    out = walk(value, DEPTH[kind])
    return G(kind, dim, None if kind == "point" and all(c is None or math.isnan(c) for c in out) else out)


def to_native(g: G | None) -> Any:
    if g is None:
        return None

    def walk(v, depth):
        return [walk(x, depth - 1) for x in v] if depth else dict(zip(g.dim, v, strict=True))

    if g.kind == "point" and g.value is None:
        return dict.fromkeys(g.dim, math.nan)
    return walk(g.value, DEPTH[g.kind])


def box_polygon(v: dict, dim: str) -> G:
    """The closed ring of a box, from its lowest corner upwards first; further axes at their least."""
    rest = tuple(v[f"{a}min"] for a in dim[2:])
    x0, y0, x1, y1 = v["xmin"], v["ymin"], v["xmax"], v["ymax"]
    return G("polygon", dim, [[(*p, *rest) for p in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))]])


# WKB


def to_wkb(g: G) -> bytes:
    """Little-endian ISO WKB."""
    n = len(g.dim)
    head = struct.pack("<BI", 1, KINDS.index(g.kind) + 1 + 1000 * DIMS.index(g.dim))
    run = lambda vs: struct.pack("<I", len(vs)) + struct.pack(f"<{n * len(vs)}d", *(c for p in vs for c in p))
    v = g.value
    if g.kind == "point":
        return head + struct.pack(f"<{n}d", *(v if v is not None else [math.nan] * n))
    if g.kind == "linestring":
        return head + run(v)
    if g.kind == "polygon":
        return head + struct.pack("<I", len(v)) + b"".join(map(run, v))
    if g.kind == "geometrycollection":
        return head + struct.pack("<I", len(v)) + b"".join(map(to_wkb, v))
    inner = {"multipoint": "point", "multilinestring": "linestring", "multipolygon": "polygon"}[g.kind]
    return head + struct.pack("<I", len(v)) + b"".join(to_wkb(G(inner, g.dim, x)) for x in v)


def from_wkb(data: bytes) -> G:
    """ISO or extended WKB, either byte order; an SRID is skipped."""
    g, end = _read(data, 0)
    if end != len(data):
        raise GeoError("bytes after the end of the WKB")
    return g


def _read(d: bytes, at: int) -> tuple[G, int]:
    if at >= len(d) or d[at] not in (0, 1):
        raise GeoError("not WKB")
    e = "<>"[1 - d[at]]
    try:
        (code,) = struct.unpack_from(e + "I", d, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        z, m = bool(code & 0x80000000), bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        if code >= 1000:
            z, m = z or code // 1000 in (1, 3), m or code // 1000 in (2, 3)
            code %= 1000
        if not 1 <= code <= 7:
            raise GeoError(f"WKB of type {code} is not supported")
        dim, kind = "xy" + "z" * z + "m" * m, KINDS[code - 1]
        n = len(dim)

        def run(at: int) -> tuple[list, int]:
            (k,) = struct.unpack_from(e + "I", d, at)
            if k * 8 * n > len(d) - at:
                raise GeoError("WKB ends early")
            c = struct.unpack_from(f"{e}{k * n}d", d, at + 4)
            return list(zip(*[iter(c)] * n, strict=True)), at + 4 + 8 * n * k

        if kind == "point":
            c = struct.unpack_from(f"{e}{n}d", d, at)
            return G(kind, dim, None if all(map(math.isnan, c)) else c), at + 8 * n
        if kind == "linestring":
            v, at = run(at)
            return G(kind, dim, v), at
        (k,) = struct.unpack_from(e + "I", d, at)
        at, v = at + 4, []
        for _ in range(k):
            if kind == "polygon":
                x, at = run(at)
            else:
                g, at = _read(d, at)
                x = g if kind == "geometrycollection" else g.value
            v.append(x)
        if kind == "multipoint":
            v = [x for x in v if x is not None]
        return G(kind, dim, v), at
    except struct.error as x:
        raise GeoError("WKB ends early") from x


# WKT


def number(c: float) -> str:
    """The shortest text that reads back the same; whole numbers without a point."""
    return str(int(c)) if c == int(c) and abs(c) < 1e15 else repr(c) if math.isfinite(c) else "NaN"


def to_wkt(g: G) -> str:
    name = g.kind.upper() + {"xy": "", "xyz": " Z", "xym": " M", "xyzm": " ZM"}[g.dim]
    return f"{name} EMPTY" if _bare(g) else f"{name} {_body(g)}"


def _bare(g: G) -> bool:
    return g.value is None or len(g.value) == 0


def _body(g: G) -> str:
    if g.kind == "geometrycollection":
        return "(" + ", ".join(map(to_wkt, g.value)) + ")"

    def walk(v, depth):
        if depth == 0:
            return " ".join(map(number, v))
        return "(" + ", ".join(walk(x, depth - 1) for x in v) + ")" if v else "EMPTY"

    if g.kind == "point":
        return f"({walk(g.value, 0)})"
    if g.kind == "multipoint":
        return "(" + ", ".join(f"({walk(x, 0)})" for x in g.value) + ")"
    return walk(g.value, DEPTH[g.kind])


_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),;=])")


def from_wkt(text: str) -> G:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GeoError(f"not WKT at character {at}")
        tokens.append(m[1])
        at = m.end()
    if tokens[:2] == ["SRID", "="]:
        tokens = tokens[4:]
    g, end = _parse(tokens, 0)
    if end != len(tokens):
        raise GeoError("text after the end of the WKT")
    return g


def _parse(t: list[str], at: int) -> tuple[G, int]:
    def peek(k: int = 0) -> str:
        if at + k >= len(t):
            raise GeoError("WKT ends early")
        return t[at + k]

    name = peek().upper()
    at += 1
    dim = "xy"
    for suffix in ("ZM", "Z", "M"):
        if name.endswith(suffix) and name[: -len(suffix)].lower() in KINDS:
            name, dim = name[: -len(suffix)], "xy" + suffix.lower()
            break
    if at < len(t) and t[at].upper() in ("Z", "M", "ZM"):
        dim = "xy" + t[at].lower()
        at += 1
    kind = name.lower()
    if kind not in KINDS:
        raise GeoError(f"unknown WKT type {name}")
    if peek().upper() == "EMPTY":
        return G(kind, dim, None if kind == "point" else []), at + 1
    width = len(dim)

    def eat(c: str) -> None:
        nonlocal at
        if peek() != c:
            raise GeoError(f"WKT: {c} expected, not {peek()}")
        at += 1

    def vertex() -> tuple:
        nonlocal at, width
        out = []
        while peek() not in (",", ")"):
            try:
                out.append(float(peek()))
            except ValueError as x:
                raise GeoError(f"WKT: number expected, not {peek()}") from x
            at += 1
        nonlocal dim
        if len(out) != width:
            if dim == "xy" and len(out) in (3, 4):  # bare third and fourth numbers
                dim, width = ("xyz", "xyzm")[len(out) - 3], len(out)
            else:
                raise GeoError(f"WKT: {width} numbers expected, not {len(out)}")
        return tuple(out)

    def many(depth: int, single: bool = False) -> list:
        nonlocal at
        if peek().upper() == "EMPTY":
            at += 1
            return []
        eat("(")
        out = []
        while True:
            if depth > 1:
                out.append(many(depth - 1))
            elif single and peek() == "(":
                eat("(")
                out.append(vertex())
                eat(")")
            elif single and peek().upper() == "EMPTY":
                at += 1
            else:
                out.append(vertex())
            if peek() == ",":
                at += 1
            else:
                break
        eat(")")
        return out

    if kind == "geometrycollection":
        eat("(")
        parts = []
        while True:
            g, at = _parse(t, at)
            parts.append(g)
            if peek() != ",":
                break
            at += 1
        eat(")")
        return G(kind, parts[0].dim if parts and dim == "xy" else dim, parts), at
    if kind == "point":
        eat("(")
        v = vertex()
        eat(")")
        return G(kind, dim, v), at
    v = many(DEPTH[kind], kind == "multipoint")
    return G(kind, dim, v), at


# GeoJSON

_JSON_NAMES = {"point": "Point", "linestring": "LineString", "polygon": "Polygon", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon", "geometrycollection": "GeometryCollection"}


def to_geojson(g: G) -> dict:
    """A GeoJSON geometry. M is left out; an empty point has no coordinates."""
    if g.kind == "geometrycollection":
        return {"type": _JSON_NAMES[g.kind], "geometries": [to_geojson(x) for x in g.value]}
    width = 3 if "z" in g.dim else 2

    def walk(v, depth):
        return [walk(x, depth - 1) for x in v] if depth else list(v[:width])

    return {"type": _JSON_NAMES[g.kind], "coordinates": [] if g.value is None else walk(g.value, DEPTH[g.kind])}


def from_geojson(x: dict | str) -> G:
    if isinstance(x, str):
        x = json.loads(x)
    kind = next((k for k, v in _JSON_NAMES.items() if v == x.get("type")), None)
    if kind is None:
        raise GeoError(f"unknown GeoJSON type {x.get('type')!r}")
    if kind == "geometrycollection":
        parts = [from_geojson(y) for y in x.get("geometries", [])]
        return G(kind, parts[0].dim if parts else "xy", parts)
    depth, c = DEPTH[kind], x.get("coordinates") or []
    flat, found = [(c, depth)], set()
    while flat:
        v, d = flat.pop()
        if d == 0:
            if v:
                found.add(len(v))
        else:
            flat += [(y, d - 1) for y in v]
    dim = "xyz" if found and min(found) >= 3 else "xy"

    def walk(v, d):
        return [walk(y, d - 1) for y in v] if d else tuple(float(k) for k in v[: len(dim)])

    if kind == "point":
        return G(kind, dim, walk(c, 0) if c else None)
    return G(kind, dim, walk(c, depth))


# SVG


def to_svg(g: G) -> str:
    """Elements of an SVG image: a circle a point, a polyline a line, a path an area with its holes, a group for several."""
    at = lambda v: f"{_plain(v[0])},{_plain(v[1])}"
    if g.kind == "point":
        return "" if g.value is None else f'<circle cx="{_plain(g.value[0])}" cy="{_plain(g.value[1])}" r="1"/>'
    if g.kind == "linestring":
        return f'<polyline points="{" ".join(map(at, g.value))}" fill="none"/>' if g.value else ""
    if g.kind == "polygon":
        return f'<path d="{" ".join("M " + " L ".join(map(at, r[:-1] if r[0] == r[-1] else r)) + " Z" for r in g.value if r)}" fill-rule="evenodd"/>' if g.value else ""
    parts = g.value if g.kind == "geometrycollection" else [G(SINGLE[g.kind], g.dim, x) for x in g.value]
    return f"<g>{''.join(map(to_svg, parts))}</g>"


def _plain(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)
