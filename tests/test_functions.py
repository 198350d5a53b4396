import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import functions as st
from tessera.functions import kernel, native
from tessera.kernels import arrange, codecs, geodesic, planar
from tessera.kernels.codecs import G, from_wkt, to_wkt, vertices
from tessera.types import DEPTH, GeoError, GeoType, geo, geometry, linestring, multipolygon, point, polygon
from tests.shapes import TYPES, column
from tests.shapes import from_wkt as frame

SQUARE = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"


def values(df, *cols):
    rows = df.orderBy("i").select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect()
    return [r[0] for r in rows] if len(cols) == 1 else [tuple(r) for r in rows]


def test_areas(spark):
    df = column(spark, "polygon")
    assert values(df, st.area(geo(df))) == [550.0, 675.0, None, 0.0]
    df = column(spark, "point")
    assert values(df, st.area(geo(df))) == [0.0, 0.0, None, 0.0]
    df = frame(spark, [["POLYGON ((0 0, 5 0, 5 6, 0 6, 0 0))"], ["POLYGON ((0 0, 0 6, 5 6, 5 0, 0 0))"]], [polygon()])
    assert values(df, st.signed_area(geo(df))) == [30.0, -30.0]


def test_lengths(spark):
    df = frame(spark, [["LINESTRING (0 0, 3 9)"], ["LINESTRING (0 0, 4 5)"], ["LINESTRING EMPTY"], [None]], [linestring()])
    assert values(df, st.length(geo(df))) == pytest.approx([math.sqrt(90), math.sqrt(41), 0.0, None])
    df = column(spark, "polygon")
    assert values(df, st.length(geo(df))) == [0.0, 0.0, None, 0.0]
    df = frame(spark, [["LINESTRING (-74.006 40.7128, -0.1278 51.5074)"]], [linestring()])
    a, b, c = values(df, st.length(geo(df), "haversine"), st.length(geo(df), "vincenty"), st.length(geo(df), "ellipsoidal"))[0]
    assert round(a) == 5570230 and b == pytest.approx(5585233.579, abs=1e-2) and c == b


def test_geodesic_area():
    perimeter, signed, unsigned = geodesic.geodesic(from_wkt("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"))
    assert signed == pytest.approx(12308778361.469, abs=1) and perimeter == pytest.approx(443770.917, abs=1e-2)
    back = geodesic.geodesic(from_wkt("POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))"))
    assert back[1] == pytest.approx(-signed) and back[2] == pytest.approx(unsigned)
    assert geodesic.geodesic(from_wkt("LINESTRING (0 0, 1 1)")) == (0, 0, 0)


def test_places(spark):
    df = frame(spark, [["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"], ["POLYGON ((0 0, 2 0, 0 0))"], ["POLYGON EMPTY"], [None]], [polygon()])
    g = geo(df)
    rows = values(df, native.centroid(g).column, native.center(g).column, native.bounding_rect(g).column)
    assert [r[0] and tuple(r[0]) for r in rows] == [(2.0, 2.0), (1.0, 0.0), None, None]
    assert [r[1] and tuple(r[1]) for r in rows] == [(2.0, 2.0), (1.0, 0.0), None, None]
    assert [r[2] and tuple(r[2]) for r in rows] == [(0, 0, 4, 4), (0, 0, 2, 0), None, None]


def test_total_bounds_of_nothing(spark):
    df = column(spark, "point").filter("g is null")
    assert tuple(native.total_bounds(df, geo(df)).first()) == (math.inf, math.inf, -math.inf, -math.inf)


def test_interpolate_and_locate(spark):
    rows = [["LINESTRING (-1 0, 0 0, 0 1)", f] for f in ("-1", "0.25", "0.5", "0.75", "2", "NaN")]
    df = spark.createDataFrame([(k, w, float(f)) for k, (w, f) in enumerate(rows)], "i int, w string, f double")
    df = df.select("i", "f", kernel.from_wkt(F.col("w"), linestring()).alias("g"))
    out = values(df, native.line_interpolate_point(geo(df, "g"), F.col("f")).column)
    assert [r and tuple(r) for r in out] == [(-1, 0), (-0.5, 0), (0, 0), (0, 0.5), (0, 1), None]
    df = frame(spark, [["LINESTRING (0 0, 10 0)", "POINT (3 5)"], ["LINESTRING (1 1, 1 1)", "POINT (0 0)"], ["LINESTRING (0 0, 1 0)", "POINT EMPTY"]], [linestring(), point()])
    assert values(df, native.line_locate_point(geo(df, "g0"), geo(df, "g1"))) == [0.3, 0.0, None]


def test_affine(spark):
    df = frame(spark, [["LINESTRING (0 0, 10 10)"]], [linestring()])
    g = geo(df)
    wkt = lambda x: df.select(kernel.to_wkt(x).column).first()[0]
    assert wkt(native.scale(g, 2)) == "LINESTRING (-5 -5, 15 15)"
    assert wkt(native.translate(g, 1, -1)) == "LINESTRING (1 -1, 11 9)"
    assert wkt(native.affine_transform(g, (1, 0, 2, 0, 1, 3, 0, 0, 1))) == "LINESTRING (2 3, 12 13)"
    p = df.select(native.rotate(g, 90).column.alias("r")).first().r
    assert [(round(v.x, 9), round(v.y, 9)) for v in p] == [(10, 0), (0, 10)]


def test_vertices(spark):
    df = frame(spark, [["LINESTRING (0 0, 10 0, 10 0, 10 5)"], ["LINESTRING (0 0)"], ["LINESTRING EMPTY"]], [linestring()])
    g = geo(df)
    out = values(df, F.size(native.densify(g, 2.5).column), F.size(native.remove_repeated_points(g).column), F.size(native.chaikin_smoothing(g, 1).column))
    assert out == [(8, 3, 8), (1, 1, 1), (0, 0, 0)]
    with pytest.raises(GeoError):
        native.densify(g, 0)


@pytest.mark.parametrize("kind", list(TYPES))
def test_every_kind_every_function(spark, kind):
    """Nulls stay null, nothing fails on empty rows."""
    df = column(spark, kind)
    g = geo(df)
    cols = [native.unsigned_area(g), native.euclidean_length(g), native.perimeter(g), native.centroid(g).column, native.is_empty(g), kernel.is_empty(g), kernel.is_valid(g), kernel.is_simple(g), kernel.convex_hull(g).column, kernel.interior_point(g).column, kernel.minimum_rotated_rect(g).column, kernel.buffer(g, 1.0).column, kernel.simplify(g, 1.0).column, kernel.simplify_vw(g, 1.0).column, kernel.simplify_vw_preserve(g, 1.0).column, kernel.relate(g, g), kernel.euclidean_distance(g, g), native.translate(g, 1, 1).column, native.chaikin_smoothing(g, 2).column, native.remove_repeated_points(g).column, kernel.geodesic_length(g), kernel.concave_hull(g).column, kernel.union(g, g).column]
    rows = df.orderBy("i").select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect()
    assert all(v is None for v in rows[2])
    assert all(v is not None for v in rows[0])


def test_predicates(spark):
    rows = [
        ["POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON ((1.5 1.5, 1.75 1.5, 1.75 1.75, 1.5 1.75, 1.5 1.5))"],
        ["POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON ((5 5, 6 5, 6 6, 5 6, 5 5))"],
        ["LINESTRING (0 0, 2 0, 2 2, 0 2, 0 0)", "POINT (2 0)"],
        ["POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0))", "POLYGON ((3 3, 4 3, 4 4, 3 4, 3 3))"],
        ["POINT (1 2)", "LINESTRING (0 0, 2 4)"],
        ["POINT (0 0)", "LINESTRING (0 0, 2 4)"],
        [None, SQUARE],
        ["POINT EMPTY", SQUARE],
    ]
    df = frame(spark, rows, [geometry(), geometry()])
    a, b = geo(df, "g0"), geo(df, "g1")
    out = values(df, kernel.contains(a, b), kernel.intersects(a, b), kernel.within(a, b), kernel.touches(a, b), kernel.disjoint(a, b))
    assert out == [(True, True, False, False, False), (False, False, False, False, True), (True, True, False, False, False), (False, True, False, True, False), (False, True, True, False, False), (False, True, False, True, False), (None,) * 5, (None,) * 5]
    with pytest.raises(Exception, match="empty point"):
        values(df, kernel.contains(a, b, strict=True))


def test_predicates_against_each_other():
    random.seed(5)
    rect = lambda: (lambda x, y, w, h: G("polygon", "xy", [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]))(*(random.randint(0, 4) for _ in "xy"), *(random.randint(1, 4) for _ in "wh"))
    for _ in range(60):
        a, b = rect(), rect()
        m, t = arrange.relate(a, b), arrange.relate(b, a)
        assert t == "".join(m[3 * j + i] for i in range(3) for j in range(3))
        assert arrange.predicate("within", a, b) == arrange.predicate("contains", b, a)
        assert arrange.predicate("intersects", a, b) != arrange.predicate("disjoint", a, b)
        assert (planar.distance(a, b) == 0) == arrange.predicate("intersects", a, b)


@pytest.mark.parametrize("a,b,m", [("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", "0F1FF0102"), (SQUARE, "LINESTRING (-1 1, 3 1)", "1F20F1102"), (SQUARE, SQUARE, "2FFF1FFF2"), ("POINT (1 1)", SQUARE, "0FFFFF212")])
def test_relate(a, b, m):
    assert arrange.relate(from_wkt(a), from_wkt(b)) == m


def area(g):
    return sum(sum((-1 if k else 1) * abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False))) / 2 for k, r in enumerate(rings)) for rings in planar._polygons(g))


def star(rng, x, y, n):
    pts = [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k, r in ((k, rng.uniform(1, 5)) for k in range(n))]
    return G("polygon", "xy", [[*pts, pts[0]]])


def test_overlays():
    rng = random.Random(2)
    for _ in range(25):
        a, b = star(rng, 0, 0, 9), star(rng, rng.uniform(-4, 4), 1, 12)
        u, i, d, s = (area(arrange.overlay(a, b, o)) for o in ("union", "intersection", "difference", "sym_difference"))
        assert u + i == pytest.approx(area(a) + area(b)) and d == pytest.approx(area(a) - i) and s == pytest.approx(u - i)
    assert to_wkt(arrange.overlay(from_wkt(SQUARE), from_wkt("LINESTRING (-1 1, 3 1)"), "intersection")) == "LINESTRING (0 1, 2 1)"
    holed = arrange.overlay(from_wkt("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))"), from_wkt("POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))"), "difference")
    assert holed.kind == "polygon" and len(holed.value) == 2


def test_buffers(spark):
    df = frame(spark, [["POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"], [None]], [polygon()])
    b = kernel.buffer(geo(df), 0.5)
    assert b.type == multipolygon()
    out = df.select("i", b.alias("b"))
    areas = values(out, st.area(geo(out, "b")))
    assert areas[1] is None and 1 + 2 + 0.75 < areas[0] < 1 + 2 + math.pi / 4
    ell = from_wkt("POLYGON ((0 0, 4 0, 4 1, 1 1, 1 4, 0 4, 0 0))")
    assert area(planar.buffer(ell, 0.3)) > area(ell) > area(planar.buffer(ell, -0.3)) > 0
    assert planar.buffer(ell, -3).value == []
    line = planar.buffer(from_wkt("LINESTRING (0 0, 10 0)"), 1)
    assert area(line) == pytest.approx(20 + math.pi, rel=0.02)


def test_hulls():
    rng = random.Random(3)
    for _ in range(30):
        pts = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randint(3, 30))]
        g = G("multipoint", "xy", pts)
        h, m, c = planar.convex_hull(g), planar.minimum_rotated_rect(g), planar.concave_hull(g)
        assert {*h.value[0]} <= {*pts} and {*c.value[0]} <= {*pts}
        assert area(c) <= area(h) + 1e-9 <= area(m) + 1e-6
        assert planar.invalid_reason(c) == planar.VALID
        assert all(arrange.Shape(h).locate_area((p[0], p[1])) != "E" for p in pts)


def test_simplification():
    rng = random.Random(4)
    for f, eps in ((planar.simplify, 1.0), (planar.simplify_vw, 1.0), (planar.simplify_vw_preserve, 1.0)):
        for _ in range(20):
            v = [(float(k), rng.uniform(0, 3)) for k in range(20)]
            out = f(G("linestring", "xy", v), eps).value
            assert {*out} <= {*v} and (out[0], out[-1]) == (v[0], v[-1])
            assert f(G("linestring", "xy", v), 0).value == v or f is planar.simplify
    ring = from_wkt("POLYGON ((0 0, 5 0.1, 10 0, 10 10, 0 10, 0 0))")
    assert len(planar.simplify(ring, 0.5).value[0]) == 5
    assert planar.simplify(from_wkt("POINT (1 1)"), 5) == from_wkt("POINT (1 1)")


@pytest.mark.parametrize(
    "wkt,ok",
    [
        (SQUARE, True), ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", False), ("POLYGON ((0 0, 1 0, 1 1))", False), ("LINESTRING (1 1, 1 1)", False),
        ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", True), ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (8 8, 12 8, 12 12, 8 12, 8 8))", False),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 1, 2 1, 2 2, 1 2, 1 1)))", True), ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((1 1, 3 1, 3 3, 1 3, 1 1)))", False),
    ],
)
def test_validity(wkt, ok):
    assert (planar.invalid_reason(from_wkt(wkt)) == planar.VALID) is ok


def test_frechet():
    f = lambda a, b: planar.frechet_distance(from_wkt(a), from_wkt(b))
    assert f("LINESTRING (0 0, 1 0, 2 0)", "LINESTRING (0 1, 1 1, 2 1)") == 1
    assert f("LINESTRING (0 0, 10 0)", "LINESTRING (10 0, 0 0)") == 10
    with pytest.raises(GeoError):
        f("POINT (0 0)", "LINESTRING (0 0, 1 1)")


def brute_frechet(p, q):
    """Over all ways to walk both lines."""
    def walk(i, j):
        here = math.dist(p[i], q[j])
        ways = [walk(a, b) for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0]
        return max(here, min(ways)) if ways else here
    return walk(len(p) - 1, len(q) - 1)


def test_frechet_and_wkt_queries_take_every_row(spark):
    """Lines of more than two vertices and points near an axis are there too."""
    import __spark_entry__ as entry
    from tessera.plans import shapes

    sf = "/root/testdata/sf0.001"
    lines = {r[0]: [(v["x"], v["y"]) for v in r[1]] for r in shapes.order_lines(spark, sf).collect()}
    found = {r[0]: r[1] for r in entry.queries()["frechet_lines"](spark, sf).collect()}
    assert max(map(len, lines.values())) > 2 and found.keys() == lines.keys()
    for k, p in lines.items():
        assert found[k] == pytest.approx(brute_frechet(p, [(0, 0), (1000, 100)]), abs=1e-6)
    points = {r[0]: (r[1]["x"], r[1]["y"]) for r in shapes.customers(spark, sf).select("c_custkey", "g").collect()}
    texts = {r[0]: r[1] for r in entry.queries()["wkt_all_points"](spark, sf).collect()}
    assert {k: from_wkt(t).value for k, t in texts.items()} == points


def test_simple():
    assert planar.is_simple(from_wkt("LINESTRING (0 0, 2 0, 2 2, 0 0)")) and planar.is_ring(from_wkt("LINESTRING (0 0, 2 0, 2 2, 0 0)"))
    assert not planar.is_simple(from_wkt("LINESTRING (0 0, 2 2, 2 0, 0 2)"))
    assert not planar.is_simple(from_wkt("MULTIPOINT ((0 0), (0 0))"))


def test_polylabel():
    p = planar.polylabel(from_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), 0.01)
    assert p.value == pytest.approx((2, 2))
    with pytest.raises(GeoError):
        planar.polylabel(from_wkt("POINT (0 0)"), 1)


def test_crs_must_agree(spark):
    df = frame(spark, [["POINT (0 0)", "POINT (1 1)"]], [point(), point(crs="EPSG:4326")])
    with pytest.raises(GeoError):
        st.distance(geo(df, "g0"), geo(df, "g1"))


def test_reproject_round_trip(spark):
    df = frame(spark, [["POINT (10 50)"], ["POINT (-170 -80)"]], [point()])
    there = native.reproject(geo(df), "EPSG:4326", "EPSG:3857")
    back = native.reproject(there, "EPSG:3857", "EPSG:4326").column
    assert values(df, F.round(back["x"], 9), F.round(back["y"], 9)) == [(10, 50), (-170, -80)]
    with pytest.raises(GeoError):
        native.reproject(geo(df), "EPSG:4326", "EPSG:2154")


def test_user_functions(spark):
    from pyspark.sql import types as T

    df = column(spark, "polygon")
    assert values(df, kernel.unary(lambda g: len(list(vertices(g))), T.LongType(), geo(df))) == [5, 9, None, 0]


def test_rings_cross_nowhere(spark):
    df = frame(spark, [["LINESTRING (0 0, 2 2, 2 0, 0 2, 0 0)"], ["LINESTRING (0 0, 2 0, 2 2, 0 0)"], ["LINESTRING (0 0, 2 0, 2 2)"], ["LINESTRING (0 0, 2 0, 0 0)"], [None]], [linestring()])
    rows = df.orderBy("i").select(native.is_closed(geo(df)).alias("c"), kernel.is_ring(geo(df)).alias("r")).collect()
    assert [tuple(r) for r in rows] == [(True, False), (True, True), (False, False), (False, False), (None, None)]


def test_utm(spark):
    """A published place (the CN Tower in zone 17), and a zone's meridian at the equator, north and south."""
    df = frame(spark, [["POINT (-79.387139 43.642567)"]], [point()])
    assert tuple(df.select(native.reproject(geo(df), "EPSG:4326", "EPSG:32617").column.alias("p")).first().p) == pytest.approx((630084, 4833438), abs=1)
    df = frame(spark, [["POINT (2.294481 48.858370)"], ["POINT (3 0)"], ["POINT (3 -33.9)"]], [point()])
    north = native.reproject(geo(df), "EPSG:4326", "EPSG:32631")
    at = [tuple(r.p) for r in df.orderBy("i").select(north.column.alias("p")).collect()]
    assert at[1] == pytest.approx((500_000, 0), abs=1e-6)
    south = native.reproject(geo(df), "EPSG:4326", "EPSG:32731")
    assert [r.p.y for r in df.orderBy("i").select(south.column.alias("p")).collect()][1:] == pytest.approx([10_000_000, 10_000_000 + at[2][1]])
    web = native.reproject(native.reproject(north, "EPSG:32631", "EPSG:3857"), "EPSG:3857", "EPSG:4326")
    for r in df.select(geo(df).column.alias("a"), web.column.alias("b")).collect():
        assert tuple(r.b) == pytest.approx(tuple(r.a), abs=1e-8)
    assert web.type.crs == "EPSG:4326" and native.utm_zone("EPSG:32661") is None and native.utm_zone("EPSG:32760") == (60, True)


def test_buffer_styles():
    square, line = from_wkt("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), from_wkt("LINESTRING (0 0, 2 0, 2 2)")
    area = lambda g: sum(abs(arrange.ring_area2(r)) / 2 * (1 if k == 0 else -1) for p in g.value for k, r in enumerate(p))
    assert area(planar.buffer(square, 0.5, join="mitre")) == pytest.approx(9)
    assert area(planar.buffer(square, 0.5, join="bevel")) == pytest.approx(8.5)
    assert area(planar.buffer(square, 0.5, join="mitre", mitre_limit=1.2)) == pytest.approx(8.5)
    assert area(planar.buffer(square, -0.5, join="mitre")) == pytest.approx(1)
    assert area(planar.buffer(line, 0.5, cap="flat", join="mitre")) == pytest.approx(4)
    assert area(planar.buffer(line, 0.5, cap="square", join="bevel")) == pytest.approx(4.875)
    assert area(planar.buffer(from_wkt("POINT (1 1)"), 1, cap="square")) == pytest.approx(4) and planar.buffer(from_wkt("POINT (1 1)"), 1, cap="flat").value == []


def test_buffers_of_convex_rings_without_overlays(monkeypatch):
    """Pointed and cut corners of convex rings, and level ends of single segments, are what unions of pieces give, and need none."""
    area = lambda g: sum(abs(arrange.ring_area2(r)) / 2 * (1 if k == 0 else -1) for p in g.value for k, r in enumerate(p))
    rng, found = random.Random(7), []
    bow = from_wkt("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))")
    for k in range(20):
        ring = planar.hull_points([(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randint(3, 9))])[:: rng.choice((1, -1))]
        styles = {"join": rng.choice(("mitre", "bevel")), "mitre_limit": rng.choice((1.2, 5.0))}
        found.append((G("polygon", "xy", [[*ring, ring[0]]]), styles))
        found.append((G("linestring", "xy", [tuple(rng.uniform(0, 9) for _ in "xy") for _ in "ab"]), {"cap": rng.choice(("flat", "square"))}))
    with monkeypatch.context() as m:
        m.setattr(planar, "_same_ring", lambda ring, h: False)
        m.setattr(planar, "_bar", lambda *a: pytest.fail())
        pieces = lambda g, **o: planar.buffer(G("multi" + g.kind, "xy", [g.value]), 0.7, **o)
        slow = [pieces(g, **o) for g, o in found] + [planar.buffer(bow, 0.5, join="mitre")]
    assert area(planar.buffer(bow, 0.5, join="mitre")) == pytest.approx(area(slow.pop()))  # no convex ring though its corners are a hull's
    monkeypatch.setattr(planar, "overlay", lambda *a: pytest.fail("an overlay"))
    for (g, o), whole in zip(found, slow, strict=True):
        assert area(planar.buffer(g, 0.7, **o)) == pytest.approx(area(whole), rel=1e-9)


def test_from_offsets(spark):
    df = spark.sql("select transform(sequence(0, 7), i -> named_struct('x', get(array(0D, 1D, 1D, 0D, 5D, 6D, 6D, 5D), i), 'y', get(array(0D, 0D, 1D, 0D, 5D, 5D, 6D, 5D), i))) c, array(0, 1, 2) a, array(0, 4, 8) b, array(0) e")
    lines = df.select(native.from_offsets("linestring", F.col("c"), F.col("b")).alias("v")).first().v
    assert [len(x) for x in lines] == [4, 4]
    polygons = df.select(native.from_offsets("polygon", F.col("c"), F.col("a"), F.col("b")).alias("v")).first().v
    assert [[len(r) for r in p] for p in polygons] == [[4], [4]]
    assert df.select(native.from_offsets("linestring", F.col("c"), F.col("e")).alias("v")).first().v == []
    with pytest.raises(GeoError):
        native.from_offsets("polygon", F.col("c"), F.col("b"))


def test_batches_by_buffers():
    """Decoding and encoding whole batches gives what rows give one by one."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    rng = random.Random(3)
    make = lambda depth: [make(depth - 1) for _ in range(rng.randint(0, 3))] if depth else (rng.random(), rng.random(), rng.random())
    for kind in ("linestring", "polygon", "multipoint", "multilinestring", "multipolygon"):
        t = GeoType(kind, "xyz")
        rows = [None if rng.random() < 0.2 else G(kind, "xyz", make(DEPTH[kind])) for _ in range(60)]
        plain = pa.array([codecs.to_native(g) for g in rows], to_arrow_type(t.storage))
        assert kernel.decode(plain, t) == rows and kernel.decode(plain.slice(7, 20), t) == rows[7:27]
        assert kernel.encode(rows, t).equals(plain) and kernel.decode(kernel.encode([], t), t) == []


def test_arrangement_in_integers_and_rationals():
    """Where coordinates are too far apart for integers, rationals give the same."""
    rng = random.Random(5)
    for _ in range(60):
        ring = lambda: (lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y)])(*(rng.uniform(0.1, 3) for _ in range(4)))
        a, b = G("polygon", "xy", [ring()]), G("polygon", "xy", [ring()])
        exact = [arrange.relate(a, b)] + [arrange.overlay(a, b, op) for op in ("intersection", "union", "difference", "sym_difference")]
        far = [G("polygon", "xy", [[(x * 2.0**-400, y * 2.0**-400) for x, y in g.value[0]]]) for g in (a, b)]
        assert arrange.scale_of(*far) is None and arrange.relate(*far) == exact[0]
        assert arrange.scale_of(a, b) is not None
    rect = lambda x, y, w, h: G("polygon", "xy", [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]])
    for _ in range(200):
        a, b = (rect(*(float(rng.randint(0, 4)) for _ in range(2)), *(float(rng.randint(1, 3)) for _ in range(2))) for _ in range(2))
        m = arrange.relate(a, b)
        for name, patterns in arrange.PATTERNS.items():
            assert arrange.predicate(name, a, b) == (any(arrange.matches(m, p) for p in patterns) != (name == "intersects"))
        assert arrange.predicate("overlaps", a, b) == arrange.matches(m, "T*T***T**") and not arrange.predicate("crosses", a, b)


def test_svg_and_chunks(spark):
    df = frame(spark, [["POINT (1 2.5)"], ["LINESTRING (0 0, 1 1)"], ["POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))"], ["MULTIPOINT ((1 2), (3 4))"], [None]], [geometry()])
    count = kernel.map_chunks(lambda rows: [None if g is None else len(list(vertices(g))) for g in rows], T.LongType(), geo(df))
    svg, n = zip(*values(df, kernel.as_svg(geo(df)), count))
    assert list(svg) == ['<circle cx="1" cy="2.5" r="1"/>', '<polyline points="0,0 1,1" fill="none"/>', '<path d="M 0,0 L 4,0 L 4,4 Z M 1,1 L 2,1 L 2,2 Z" fill-rule="evenodd"/>', '<g><circle cx="1" cy="2" r="1"/><circle cx="3" cy="4" r="1"/></g>', None]
    assert list(n) == [1, 2, 8, 2, None]


def test_geodesic_lengths_of_whole_columns():
    """All steps at once give what steps one by one give, near antipodes and along meridians too."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    rng = random.Random(8)
    spot = lambda: rng.choice([(rng.uniform(-180, 180), rng.uniform(-90, 90)), (0.0, 0.0), (179.7, 0.5), (10.0, rng.uniform(-80, 80)), (rng.uniform(-180, 180), 0.0)])
    for kind, make in (("linestring", lambda: [spot() for _ in range(rng.randint(0, 5))]), ("multilinestring", lambda: [[spot() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 3))])):
        rows = [None if rng.random() < 0.1 else G(kind, "xy", make()) for _ in range(150)]
        values = pa.array([codecs.to_native(g) for g in rows], to_arrow_type(GeoType(kind).storage))
        for over, one in ((True, geodesic.geodesic_length), (False, geodesic.vincenty_length)):
            got = geodesic.lengths(values, 1 if kind == "linestring" else 2, over).to_pylist()
            for g, x in zip(rows, got, strict=True):
                want = None if g is None else one(g)
                assert (x is None) == (want is None) and (want is None or x == pytest.approx(want, rel=1e-9, abs=1e-6))
