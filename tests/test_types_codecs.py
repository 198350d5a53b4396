import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tessera.functions import kernel, native
from tessera.kernels import codecs
from tessera.kernels.codecs import G
from tessera.operators.downcast import common_type, downcast, infer_downcast_type
from tessera.types import DIMS, GeoError, GeoType, box, geo, geometry, geometry_columns, infer, linestring, multipoint, point, polygon
from tests.shapes import TYPES, WKT, column, from_wkt

number = st.floats(-1e9, 1e9, allow_nan=False)


def vertex(dim):
    return st.tuples(*[number] * len(dim))


@st.composite
def geometries(draw, depth=1):
    dim = draw(st.sampled_from(DIMS))
    v = st.lists(vertex(dim), min_size=1, max_size=4)
    kind = draw(st.sampled_from(["point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon"] + ["geometrycollection"] * depth))
    if kind == "geometrycollection":
        return G(kind, dim, [g for g in draw(st.lists(geometries(depth=0), min_size=1, max_size=3)) if g.dim == dim])
    rings = st.lists(v, min_size=1, max_size=3)
    return G(kind, dim, draw({"point": vertex(dim), "linestring": v, "polygon": rings, "multipoint": v, "multilinestring": rings, "multipolygon": st.lists(rings, min_size=1, max_size=2)}[kind]))


@settings(max_examples=150, deadline=None)
@given(geometries())
def test_codecs_round_trip(g):
    assert codecs.from_wkb(codecs.to_wkb(g)) == g
    if g.kind != "geometrycollection" or g.value:
        assert codecs.from_wkt(codecs.to_wkt(g)) == g
    if g.dim in ("xy", "xyz") and g.kind != "geometrycollection":
        assert codecs.from_geojson(codecs.to_geojson(g)) == g
        assert codecs.from_native(g.kind, g.dim, codecs.to_native(g)) == g


def test_wkb_variants():
    assert codecs.from_wkb(struct.pack(">BIdd", 0, 1, 3, 4)) == G("point", "xy", (3, 4))
    assert codecs.from_wkb(struct.pack("<BIIddd", 1, 0xA0000001, 4326, 1, 2, 3)) == G("point", "xyz", (1, 2, 3))
    for bad in (b"", b"\x02", b"\x01\x01", struct.pack("<BIdd", 1, 1, 3, 4) + b"x", struct.pack("<BII", 1, 2, 99)):
        with pytest.raises(GeoError):
            codecs.from_wkb(bad)


@pytest.mark.parametrize("text", ["POINT (1)", "POINT 1 2", "LINESTRING (1 2, 3)", "CIRCLE (1 2)", "POINT (1 2) x", "POINT (1 2", ""])
def test_bad_wkt(text):
    with pytest.raises(GeoError):
        codecs.from_wkt(text)


def test_wkt_forms():
    assert codecs.to_wkt(codecs.from_wkt("point z(1 2 3)")) == "POINT Z (1 2 3)"
    assert codecs.from_wkt("MULTIPOINT (1 2, 3 4)") == codecs.from_wkt("MULTIPOINT ((1 2), (3 4))")
    assert codecs.from_wkt("SRID=4326;POINT(1.5 2)").value == (1.5, 2)
    assert codecs.to_wkt(G("point", "xyzm", None)) == "POINT ZM EMPTY"


@pytest.mark.parametrize("kind", list(WKT))
def test_columns_round_trip(spark, kind):
    df = column(spark, kind)
    g = geo(df, "g")
    assert g.type == TYPES[kind] and geometry_columns(df) == ["g"]
    wkb = kernel.to_wkb(g)
    out = df.select("i", kernel.to_wkt(g).column.alias("a"), kernel.to_wkt(wkb).column.alias("b"), native.type_id(g).alias("t"), native.type_id(wkb).alias("u")).orderBy("i").collect()
    assert [r.a for r in out] == WKT[kind] == [r.b for r in out]
    assert [r.t for r in out] == [r.u for r in out] == [None if w is None else TYPES[kind].type_id for w in WKT[kind]]


def test_type_ids():
    assert [GeoType("polygon", d).type_id for d in DIMS] == [3, 13, 23, 33]
    assert box().type_id == 3 and geometry().type_id is None


def test_infer():
    d = T.DoubleType()
    struct_ = lambda names: T.StructType([T.StructField(n, d) for n in names])
    assert infer(T.StructField("a", struct_("ab"))) == point()
    assert infer(T.StructField("a", struct_("xym"))).dim == "xyz"
    assert infer(T.StructField("a", T.BinaryType())).kind == "wkb" and infer(T.StructField("a", T.StringType())).kind == "wkt"
    with pytest.raises(GeoError):
        infer(T.StructField("a", T.LongType()))
    with pytest.raises(GeoError):
        infer(T.StructField("a", T.StringType(), True, point().metadata()))


def test_geometry_column_choice(spark):
    df = column(spark, "point")
    assert geo(df).type == point()
    with pytest.raises(GeoError):
        geo(df.drop("g"))
    with pytest.raises(GeoError):
        geo(df.withColumn("h", geo(df).alias("h")))


def test_cast_rules(spark):
    df = column(spark, "multipoint")
    g = geo(df, "g")
    with pytest.raises(Exception, match="several parts"):
        df.select(native.to_single(g).column.alias("p")).collect()
    ok = df.filter("i != 1")
    rows = ok.select(kernel.to_wkt(kernel.cast(geo(ok, "g"), point())).column.alias("w")).collect()
    assert [r.w for r in rows] == ["POINT (30 10)", None, "POINT EMPTY"]
    with pytest.raises(GeoError):
        kernel.cast(g, linestring())
    with pytest.raises(GeoError):
        kernel.cast(g, multipoint("xyz"))
    with pytest.raises(GeoError):
        kernel.cast(g, multipoint(crs="EPSG:4326", crs_form="authority_code"))
    b = native.bounding_rect(g)
    for t in (polygon(), geometry(), box("xyz")):
        with pytest.raises(GeoError):
            kernel.cast(b, t)
    assert kernel.to_wkt(b).type.kind == "wkt"


def test_one_member_collections_unwrap(spark):
    df = spark.createDataFrame([("GEOMETRYCOLLECTION (POINT (1 2))",)], "w string")
    from pyspark.sql import functions as F

    assert codecs.from_wkb(bytes(df.select(kernel.from_wkt(F.col("w"), geometry()).column).first()[0])) == G("point", "xy", (1.0, 2.0))


def test_common_type():
    assert common_type({1}, geometry()).kind == "point"
    assert common_type({1, 4}, geometry()).kind == "multipoint"
    assert common_type({13, 16}, geometry()) == GeoType("multipolygon", "xyz")
    assert common_type({1, 2}, geometry()) is None and common_type({1, 11}, geometry()) is None
    with pytest.raises(GeoError):
        common_type(set(), geometry())


def test_downcast(spark):
    df = column(spark, "multipoint").filter("i != 1")
    assert infer_downcast_type(df, "g") == point()
    assert geo(downcast(df, "g"), "g").type == point()
    with pytest.raises(GeoError):
        infer_downcast_type(df.filter("g is null"), "g")


def test_null_is_not_empty(spark):
    df = column(spark, "point")
    rows = df.orderBy("i").collect()
    assert rows[2].g is None and math.isnan(rows[3].g.x)


def test_geojson_column(spark):
    df = from_wkt(spark, [["POLYGON ((0 0, 1 0, 1 1, 0 0))"]], [polygon()])
    j = df.select(kernel.as_geojson(geo(df, "g0")).alias("j"))
    assert j.first().j == '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]}'
    back = j.select(kernel.from_geojson(j.j, polygon()).alias("g"))
    assert back.select(kernel.to_wkt(geo(back, "g")).column).first()[0] == "POLYGON ((0 0, 1 0, 1 1, 0 0))"


@pytest.mark.parametrize("dim", ["xy", "xyz", "xym", "xyzm"])
@pytest.mark.parametrize("kind", ["point", "linestring", "polygon"])
def test_wkb_of_whole_columns(kind, dim):
    """Columns at once give what rows give one by one, slices and nulls too; what is not uniform is left to the rows."""
    import random

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from tessera.kernels import codecs, wkb
    from tessera.kernels.codecs import G
    from tessera.types import DEPTH, GeoType

    rng, t = random.Random(7), GeoType(kind, dim)
    make = lambda depth: [make(depth - 1) for _ in range(rng.randint(0, 4))] if depth else tuple(rng.random() for _ in dim)
    for _ in range(12):
        rows = [None if rng.random() < 0.2 else G(kind, dim, None if kind == "point" and rng.random() < 0.1 else make(DEPTH[kind])) for _ in range(rng.randint(0, 40))]
        native = pa.array([codecs.to_native(g) for g in rows], to_arrow_type(t.storage))
        want = [None if g is None else codecs.to_wkb(g) for g in rows]
        a, z = sorted((rng.randint(0, len(rows)), rng.randint(0, len(rows))))
        assert wkb.encode(native, kind, dim).to_pylist() == want and wkb.encode(native.slice(a, z - a), kind, dim).to_pylist() == want[a:z]
        plain = pa.array(want, pa.binary())
        assert str(wkb.decode(plain, kind, dim).cast(native.type).to_pylist()) == str(native.to_pylist())
        assert str(wkb.decode(plain.slice(a, z - a), kind, dim).cast(native.type).to_pylist()) == str(native.to_pylist()[a:z])
        if any(want):
            cut = [x[:-1] if x else x for x in want]
            other = [*want, codecs.to_wkb(G("multipoint", dim, [])), b"\x00" + bytes(30)]
            assert wkb.decode(pa.array(cut, pa.binary()), kind, dim) is None and wkb.decode(pa.array(other, pa.binary()), kind, dim) is None
