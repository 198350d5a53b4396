import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import kernel, native
from tessera.operators.explode import explode
from tessera.operators.index import index_chunks, search_chunks
from tessera.operators.join import bbox_filter, candidates, cell_size, count_join, distance_join, spatial_join
from tessera.sources import flatgeobuf, geoparquet, shapefile, text
from tessera.streaming.geofence import fence_counts, in_fences
from tessera.types import Geo, GeoError, geo, geometry, linestring, multilinestring, multipolygon, point, polygon
from tests.shapes import WKT, column
from tests.shapes import from_wkt as frame


def plan(df):
    return df._jdf.queryExecution().toString()


def rects(spark, seed, n, names, most):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, w, h = rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.1, 1, most]) * rng.random(), rng.random()
        rows.append((k, x, y, x + w, y + h))
    rows.append((n, None, None, None, None))
    df = spark.createDataFrame(rows, f"{names}_id int, x0 double, y0 double, x1 double, y1 double")
    b = native.make_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    b = Geo(F.when(F.col("x0").isNotNull(), b.column), b.type)
    return df.select(f"{names}_id", native.box_to_polygon(b).alias(names)), rows[:-1]


@pytest.mark.parametrize("size", [None, 0.3, 50.0])
def test_spatial_join_is_complete(spark, size):
    (a, ra), (b, rb) = rects(spark, 1, 60, "a", 12), rects(spark, 2, 70, "b", 0.5)
    want = sorted((x[0], y[0]) for x in ra for y in rb if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    got = spatial_join(a, b, "a", "b", "intersects", size=size)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want and len(want) > 10
    left = {x for x, _ in want}
    assert sorted(r.a_id for r in spatial_join(a, b, "a", "b", "intersects", "semi", size).collect()) == sorted(left)
    assert sorted(r.a_id for r in spatial_join(a, b, "a", "b", "intersects", "anti", size).collect()) == [k for k in range(61) if k not in left]
    outer = spatial_join(a, b, "a", "b", "intersects", "left", size).collect()
    assert len(outer) == len(want) + 61 - len(left)


def test_geometries_are_joined_once(spark):
    """Where one side is only looked for, or pairs are only counted, rows that share a geometry are no more pairs."""
    df = spark.sql("select id i, named_struct('x', id % 4 * 1D, 'y', 0D) p from range(400) union all select 400, null union all select 401, named_struct('x', double('nan'), 'y', double('nan'))")
    zones = spark.sql("select id k, array(array(named_struct('x', w, 'y', -1D), named_struct('x', w + 1.5D, 'y', -1D), named_struct('x', w + 1.5D, 'y', 1D), named_struct('x', w, 'y', 1D), named_struct('x', w, 'y', -1D))) z from (select id, id % 3 * 10D - 0.25D w from range(300))")
    points, areas = df.select("i", Geo(F.col("p"), point()).alias("p")), zones.select("k", Geo(F.col("z"), polygon()).alias("z"))
    tested = spark.sparkContext.accumulator(0)

    def test(a, b):
        def meets(x, y):
            tested.add(1)
            return x.value is not None and y.value[0][0][0] <= x.value[0] <= y.value[0][1][0]

        return kernel.binary(meets, T.BooleanType(), a, b)

    assert {r.k: r.n for r in count_join(points, areas, "p", "z", test, 2.0).collect()} == {k: 200 for k in range(0, 300, 3)}
    assert sorted(r.i for r in spatial_join(points, areas, "p", "z", test, "semi", 2.0).collect()) == [k for k in range(400) if k % 4 < 2]
    assert sorted(r.i for r in spatial_join(points, areas, "p", "z", test, "anti", 2.0).collect()) == [k for k in range(400) if k % 4 > 1] + [400, 401]
    assert tested.value <= 3 * 12
    with pytest.raises(GeoError):
        count_join(points, areas.withColumnRenamed("k", "n"), "p", "z")


def test_spatial_join_has_no_nested_loop(spark):
    (a, _), (b, _) = rects(spark, 1, 20, "a", 2), rects(spark, 2, 20, "b", 2)
    text_ = plan(candidates(a, geo(a, "a"), b, geo(b, "b"), 1.0))
    assert "NestedLoop" not in text_ and "Cartesian" not in text_


def test_joins_of_same_names(spark):
    a, _ = rects(spark, 1, 5, "a", 2)
    with pytest.raises(GeoError):
        spatial_join(a, a, "a", "a")


def test_distance_join(spark):
    rng = random.Random(4)
    pts = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(80)]
    df = spark.createDataFrame(pts, "i int, x double, y double")
    g = native.make_point(F.col("x"), F.col("y"))
    a, b = df.select(F.col("i").alias("i"), g.alias("a")), df.select(F.col("i").alias("j"), g.alias("b"))
    got = sorted((r.i, r.j) for r in distance_join(a, b, "a", "b", 1.0).collect())
    assert got == sorted((p[0], q[0]) for p in pts for q in pts if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 1)


@pytest.mark.parametrize("kind,parts", [("multipoint", [1, 4]), ("multilinestring", [1, 2]), ("multipolygon", [1, 2])])
def test_explode(spark, kind, parts):
    df = column(spark, kind).select("g", "i")  # the geometry goes to the end
    out = explode(df, "g", "part")
    assert out.columns == ["i", "part", "g"] and geo(out, "g").type.kind == kind.removeprefix("multi")
    assert {r.i: r.n for r in out.groupBy("i").agg(F.count("g").alias("n")).collect()} == {0: parts[0], 1: parts[1], 2: 0, 3: 0}
    mixed = df.withColumn("g", kernel.cast(geo(df, "g"), geometry()).alias("g"))
    assert explode(mixed, "g").filter("g is not null").count() == sum(parts)
    single = column(spark, "point")
    assert explode(single, "g").count() == 4


# files


@pytest.mark.parametrize("kind", list(WKT))
@pytest.mark.parametrize("encoding", ["WKB", "native"])
def test_geoparquet_round_trip(spark, tmp_path, kind, encoding):
    df = column(spark, kind)
    path = str(tmp_path / "g")
    geoparquet.write_geoparquet(df.coalesce(1), path, encoding)
    back = geoparquet.read_geoparquet(spark, path)
    assert [r.w for r in back.orderBy("i").select(kernel.to_wkt(geo(back, "g")).column.alias("w")).collect()] == WKT[kind]
    with pytest.raises(GeoError):
        geoparquet.write_geoparquet(df, path)


def test_geoparquet_footer_and_filter(spark, tmp_path):
    df = frame(spark, [["POINT (1 4)"], ["POINT (2 5)"], ["POINT (3 6)"], [None], ["POINT EMPTY"]], [point()]).withColumnRenamed("g0", "geometry")
    path = str(tmp_path / "g")
    geoparquet.write_geoparquet(df.coalesce(1), path, generate_covering=True)
    d = geoparquet.GeoParquetDataset.open(spark, path)
    meta = d.meta.columns["geometry"]
    assert d.meta.version == "1.1.0" and meta["bbox"] == [1, 4, 3, 6] and meta["geometry_types"] == ["Point"]
    assert meta["covering"] == {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    assert (d.num_rows, d.num_row_groups, d.row_group_bounds()) == (5, 1, [(1.0, 4.0, 3.0, 6.0)])
    near = d.read(bbox=(2.5, 6.5, 1.5, 4.5))
    assert [r.i for r in near.collect()] == [1] and "GreaterThanOrEqual(bbox.xmax" in plan(near)
    assert d.read(bbox=(50, 50, 60, 60)).count() == 0 and d.read(limit=2).count() == 2 and d.read(offset=4).count() == 1
    assert d.read(columns=["i"]).columns == ["i"]


def test_geoparquet_skips_files(spark, tmp_path):
    path = str(tmp_path / "g")
    df = frame(spark, [[f"POINT ({k} {k})"] for k in range(20)], [point()])
    geoparquet.write_geoparquet(df.repartitionByRange(4, "i"), path, "native")
    d = geoparquet.GeoParquetDataset.open(spark, path)
    assert len(d.fragments()) == 4
    near = d.read(bbox=(0, 0, 2, 2))
    assert near.count() == 3 and len(near.inputFiles()) == 1 and "PushedFilters: [IsNotNull(g0.x)" in plan(near)


def test_geoparquet_errors(spark, tmp_path):
    plain = str(tmp_path / "p")
    spark.range(3).write.parquet(plain)
    with pytest.raises(GeoError):
        geoparquet.GeoParquetDataset.open(spark, plain)
    with pytest.raises(GeoError):
        geoparquet.write_geoparquet(spark.range(3), str(tmp_path / "q"))
    a = geoparquet.GeoMeta("1.1.0", "g", {"g": {"encoding": "WKB", "geometry_types": ["Point"], "bbox": [0, 0, 1, 1]}})
    b = geoparquet.GeoMeta("1.1.0", "g", {"g": {"encoding": "WKB", "geometry_types": ["Point"], "bbox": [-1, 2, 3, 4]}})
    assert geoparquet.merge([a, b]).columns["g"]["bbox"] == [-1, 0, 3, 4]
    for other in ({"encoding": "point"}, {"geometry_types": ["Polygon"]}, {"crs": None}, {"bbox": [0, 0, 0, 1, 1, 1]}):
        with pytest.raises(GeoError):
            geoparquet.merge([a, geoparquet.GeoMeta("1.1.0", "g", {"g": b.columns["g"] | other})])


def test_crs_survives(spark, tmp_path):
    df = frame(spark, [["POINT (1 2)"]], [point(crs="EPSG:3857", crs_form="authority_code", edges="spherical")])
    path = str(tmp_path / "g")
    geoparquet.write_geoparquet(df, path)
    t = geo(geoparquet.read_geoparquet(spark, path)).type
    assert (t.crs, t.edges) == ("EPSG:3857", "spherical")


@pytest.mark.parametrize("kind", list(WKT))
@pytest.mark.parametrize("index", [True, False])
def test_flatgeobuf_round_trip(spark, tmp_path, kind, index):
    df = column(spark, kind).filter("i < 2").withColumn("name", F.concat(F.lit("é"), "i")).withColumn("none", F.lit(None).cast("double"))
    path = str(tmp_path / "f")
    flatgeobuf.write_flatgeobuf(df.coalesce(1), path, index=index, title="a title")
    back = flatgeobuf.read_flatgeobuf(spark, path, geometry_name="g")
    rows = back.orderBy("i").select("i", "name", "none", kernel.to_wkt(geo(back, "g")).column.alias("w")).collect()
    assert [tuple(r) for r in rows] == [(k, f"é{k}", None, WKT[kind][k]) for k in range(2)]
    from tessera.sources.paths import list_files

    h = flatgeobuf.read_header(spark, list_files(spark, path, ".fgb")[0])
    assert (h.title, h.count, bool(h.node_size), h.kind) == ("a title", 2, index, kind)


def test_flatgeobuf_box_and_columns(spark, tmp_path):
    rng = random.Random(6)
    pts = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(500)]
    df = frame(spark, [[f"POINT ({x} {y})"] for x, y in pts], [point()])
    box = (2, 3, 5, 4.5)
    want = sorted(k for k, (x, y) in enumerate(pts) if 2 <= x <= 5 and 3 <= y <= 4.5)
    for index in (True, False):
        path = str(tmp_path / f"f{index}")
        flatgeobuf.write_flatgeobuf(df.repartition(2), path, index=index)
        assert sorted(r.i for r in flatgeobuf.read_flatgeobuf(spark, path, bbox=box).collect()) == want
    assert flatgeobuf.read_flatgeobuf(spark, path, read_geometry=False).columns == ["i"]
    assert flatgeobuf.read_flatgeobuf(spark, path, columns=[]).columns == ["geometry"]
    with pytest.raises(GeoError):
        flatgeobuf.read_flatgeobuf(spark, path, columns=["nope"])


def test_flatgeobuf_types(spark, tmp_path):
    df = spark.sql("select cast(1 as tinyint) a, cast(-2 as smallint) b, 3 c, 4L d, cast(1.5 as float) e, 2.5D f, true g, 'ü' h, X'0102' i, timestamp_ntz'2020-01-02 03:04:05.000006' j, array(1, 2) k")
    df = df.withColumn("geometry", native.make_point(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("geometry"))
    path = str(tmp_path / "f")
    flatgeobuf.write_flatgeobuf(df, path, promote_to_multi=True)
    r = flatgeobuf.read_flatgeobuf(spark, path).first()
    assert r[:10] == df.first()[:10] and json.loads(r.k) == [1, 2] and [tuple(p) for p in r.geometry] == [(1, 2, 3)]


def test_flatgeobuf_packed_index():
    rng = random.Random(8)
    boxes = [(x, y, x + rng.random(), y + rng.random()) for x, y in ((rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(333))]
    index = flatgeobuf.pack_index(boxes, list(range(333)), 4)
    q = (2, 2, 4, 3)
    want = [k for k, b in enumerate(boxes) if b[2] >= q[0] and b[3] >= q[1] and b[0] <= q[2] and b[1] <= q[3]]
    assert flatgeobuf.search(index, 333, 4, q) == want
    assert len({flatgeobuf.hilbert(x, y, 3) for x in range(8) for y in range(8)}) == 64


def test_csv(spark, tmp_path):
    path = tmp_path / "incidents.csv"
    path.write_text('address,type,report location\n1 A St,x,POINT (-122.329051 47.6069)\n"2, B St",y,\n')
    df = text.read_csv(spark, str(path), point(), "report location")
    rows = df.select("address", F.col("`report location`.x").alias("x")).collect()
    assert [tuple(r) for r in rows] == [("1 A St", -122.329051), ("2, B St", None)]
    with pytest.raises(GeoError):
        text.read_csv(spark, str(path))
    text.write_csv(column(spark, "polygon").filter("i < 2"), str(tmp_path / "out"))
    back = text.read_csv(spark, str(tmp_path / "out"), polygon(), "g", "i int, g string")
    assert [r.w for r in back.orderBy("i").select(kernel.to_wkt(geo(back, "g")).column.alias("w")).collect()] == WKT["polygon"][:2]


def test_geojson(spark, tmp_path):
    df = column(spark, "multipolygon").filter("i < 3").select(F.col("i").alias("id"), F.concat(F.lit('a"\\'), "i").alias("name"), "g")
    df = df.withColumn("g", Geo(F.col("g"), multipolygon()).alias("g"))
    text.write_geojson(df.coalesce(1), str(tmp_path / "j"))
    text.write_geojson_lines(df, str(tmp_path / "l"))
    doc = json.loads(next((tmp_path / "j").glob("part*")).read_text())
    assert doc["type"] == "FeatureCollection" and [f["id"] for f in doc["features"]] == [0, 1, 2] and doc["features"][2]["geometry"] is None
    for back in (text.read_geojson(spark, str(tmp_path / "j"), multipolygon()), text.read_geojson_lines(spark, str(tmp_path / "l"), multipolygon())):
        rows = back.orderBy("id").select("id", "name", kernel.to_wkt(geo(back, "geometry")).column.alias("w")).collect()
        assert [tuple(r) for r in rows] == [(str(k), f'a"\\{k}', WKT["multipolygon"][k]) for k in range(3)]
    text.write_geojson(df.filter("id > 5").coalesce(1), str(tmp_path / "e"))
    assert json.loads(next((tmp_path / "e").glob("part*")).read_text())["features"] == []


def test_ewkb(spark):
    raw = struct.pack("<BIIdd", 1, 0x20000001, 4326, 1, 2)
    df = spark.createDataFrame([(raw.hex(), raw)], "a string, b binary")
    for c in ("a", "b"):
        out = text.from_ewkb(df, c, point())
        assert tuple(out.first()[c]) == (1.0, 2.0)


def write_shapefile(path, code, shapes, rows):
    records = b"".join(struct.pack(">ii", k + 1, len(s) // 2) + s for k, s in enumerate(shapes))
    (path / "x.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, code, *[0.0] * 8) + records)
    columns = [(b"NAME", b"C", 8, 0), (b"N", b"N", 6, 0), (b"V", b"N", 8, 2), (b"D", b"D", 8, 0), (b"OK", b"L", 1, 0)]
    head = struct.pack("<BBBBIHH20x", 3, 20, 1, 1, len(rows), 32 + 32 * len(columns) + 1, 1 + sum(c[2] for c in columns))
    head += b"".join(struct.pack("<11sc4xBB14x", n, k, size, d) for n, k, size, d in columns) + b"\r"
    (path / "x.dbf").write_bytes(head + b"".join(r for r in rows))


def test_shapefile(spark, tmp_path):
    shell, hole = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    poly = struct.pack("<i4diiii", 5, 0, 0, 9, 9, 2, 10, 0, 5) + struct.pack("<20d", *[c for p in shell + hole for c in p])
    rows = [b" " + b"a\xc3\xa4".ljust(8) + b"    42" + b"    1.25" + b"20200131" + b"T", b" " + b" " * 8 + b" " * 6 + b" " * 8 + b" " * 8 + b"?"]
    write_shapefile(tmp_path, 5, [poly, struct.pack("<i", 0)], rows)
    df = shapefile.read_shapefile(spark, str(tmp_path), crs="EPSG:4326")
    assert geo(df).type.kind == "multipolygon" and geo(df).type.crs == "EPSG:4326"
    r = df.select("NAME", "N", "V", F.col("D").cast("string").alias("D"), "OK", kernel.to_wkt(geo(df)).column.alias("w")).collect()
    assert tuple(r[0]) == ("aä", 42, 1.25, "2020-01-31", True, "MULTIPOLYGON (((0 0, 0 9, 9 9, 9 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)))")
    assert tuple(r[1]) == (None,) * 6


def test_shapefile_lines(spark, tmp_path):
    line = struct.pack("<i4diii", 13, 0, 0, 1, 1, 1, 2, 0) + struct.pack("<4d", 0, 0, 1, 1) + struct.pack("<4d", 5, 6, 5, 6)
    write_shapefile(tmp_path, 13, [line], [b" " + b"x" * 8 + b"     1" + b"    1.00" + b"20200101" + b"F"])
    df = shapefile.read_shapefile(spark, str(tmp_path))
    assert geo(df).type == multilinestring("xyz")
    assert df.select(kernel.to_wkt(geo(df)).column).first()[0] == "MULTILINESTRING Z ((0 0 5, 1 1 6))"


def test_fences_over_a_stream(spark, tmp_path):
    fences = frame(spark, [["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"], ["POLYGON ((3 3, 6 3, 6 6, 3 6, 3 3))"]], [polygon()]).withColumnRenamed("i", "fence")
    rows = [("2024-01-01 00:00:01", 1.0, 1.0), ("2024-01-01 00:00:30", 3.5, 3.5), ("2024-01-01 00:01:10", 5.0, 5.0), ("2024-01-01 00:01:20", 50.0, 5.0)]
    spark.createDataFrame(rows, "t string, x double, y double").selectExpr("cast(t as timestamp) t", "x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, x double, y double").parquet(str(tmp_path / "in"))
    points = stream.withColumn("p", native.make_point(F.col("x"), F.col("y")).alias("p"))
    counts = fence_counts(in_fences(points, fences, "p", "g0", 5.0), "t", "1 minute", "10 minutes", "fence")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("fences").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = {(str(r.window.start)[14:16], r.fence): r.n for r in spark.table("fences").collect()}
    finally:
        q.stop()
    assert got == {("00", 0): 2, ("00", 1): 1, ("01", 1): 1}


def test_join_keeps_columns_of_any_name(spark):
    left = frame(spark, [["POINT (1 1)"], ["POINT (9 9)"], ["POINT (5 5)"]], [point()]).withColumnsRenamed({"i": "a"})
    for c in ("_lbox", "_row", "_c", "_llevel", "_tl", "_TLbox", "_t_row"):
        left = left.withColumn(c, F.concat(F.lit(c), F.col("a")))
    zones = frame(spark, [["POLYGON ((0 0, 0 6, 6 6, 6 0, 0 0))"]], [polygon()]).withColumnsRenamed({"i": "z", "g0": "zone"}).withColumn("_rbox", F.lit("r"))
    inner = spatial_join(left, zones, "g0", "zone", "within")
    assert inner.columns == [*left.columns, *zones.columns]
    assert sorted((r.a, r._lbox, r._row, r._c, r._rbox) for r in inner.collect()) == [(k, f"_lbox{k}", f"_row{k}", f"_c{k}", "r") for k in (0, 2)]
    for how, want in (("semi", [0, 2]), ("anti", [1]), ("left", [0, 1, 2])):
        out = spatial_join(left, zones, "g0", "zone", "within", how)
        assert out.columns[: len(left.columns)] == left.columns and sorted((r.a, r._row) for r in out.collect()) == [(k, f"_row{k}") for k in want]
    parts = explode(left.withColumn("_place", F.lit(7)), "g0")
    assert {r._place for r in parts.collect()} == {7}


def test_cells_fit_where_rows_lie_close(spark):
    """A town in a world table: pairs that are tested stay near those that hit."""
    rng = random.Random(12)
    place = lambda: (rng.uniform(10, 11), rng.uniform(50, 51)) if rng.random() < 0.9 else (rng.uniform(-180, 180), rng.uniform(-90, 90))
    boxes = spark.createDataFrame([(k, *place()) for k in range(3000)], "z long, x double, y double").select("z", native.box_to_polygon(native.make_box(F.col("x"), F.col("y"), F.col("x") + 0.001, F.col("y") + 0.001)).alias("zone"))
    size = cell_size(boxes, geo(boxes, "zone"))
    assert 0.001 <= size < 0.3
    points = spark.createDataFrame([(k, *place()) for k in range(6000)], "a long, x double, y double").select("a", native.make_point(F.col("x"), F.col("y")).alias("g"))
    cells = lambda df, x, y: df.groupBy(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy")).agg(F.count("*").alias("n"))
    a, b = cells(points, F.col("g.x"), F.col("g.y")), cells(boxes, F.col("zone")[0][0]["x"], F.col("zone")[0][0]["y"])
    tested = a.withColumnRenamed("n", "m").join(b, ["cx", "cy"]).agg(F.sum(F.col("m") * F.col("n"))).first()[0]
    assert tested <= 100 * 6000  # 16 million if the town were one cell
    hits = spatial_join(points, boxes, "g", "zone", "intersects")
    assert hits.count() == spatial_join(points, boxes, "g", "zone", "intersects", size=0.001).count()


def test_geoparquet_parts_of_different_kinds(spark, tmp_path):
    df = frame(spark, [["POINT (1 4)"], ["POLYGON ((0 0, 0 6, 6 6, 6 0, 0 0))"], ["LINESTRING (7 8, 9 9)"], [None]], [geometry()])
    path = str(tmp_path / "g")
    geoparquet.write_geoparquet(df.repartitionByRange(4, "i"), path, generate_covering=True)
    d = geoparquet.GeoParquetDataset.open(spark, path)
    assert len(d.files) == 4 and d.meta.columns["g0"]["geometry_types"] == ["LineString", "Point", "Polygon"] and d.meta.columns["g0"]["bbox"] == [0, 0, 9, 9]
    back = d.read()
    assert [r.w for r in back.orderBy("i").select(kernel.to_wkt(geo(back, "g0")).column.alias("w")).collect()] == ["POINT (1 4)", "POLYGON ((0 0, 0 6, 6 6, 6 0, 0 0))", "LINESTRING (7 8, 9 9)", None]
    assert [r.i for r in d.read(bbox=(6.5, 7, 10, 10)).collect()] == [2]


@pytest.mark.parametrize("encoding", ["WKB", "native"])
def test_geoparquet_without_rows(spark, tmp_path, encoding):
    df = frame(spark, [["POINT (1 4)"]], [point()])
    path = str(tmp_path / "g")
    geoparquet.write_geoparquet(df.filter("i > 5"), path, encoding, generate_covering=True)
    back = geoparquet.read_geoparquet(spark, path)
    assert back.count() == 0 and set(df.columns) < set(back.columns) and geoparquet.GeoParquetDataset.open(spark, path).num_rows == 0
    # tasks without rows leave no files beside those with rows
    path = str(tmp_path / "h")
    geoparquet.write_geoparquet(df.repartition(5), path, encoding)
    assert len(geoparquet.GeoParquetDataset.open(spark, path).files) == 1


def test_addresses_for_tasks():
    from tessera.sources.paths import arrow_uri

    assert [arrow_uri(p) for p in ("s3a://b/x", "s3://b/x", "abfss://c@a/x", "hdfs://h:9/x", "/a/b", "file:/a/b", "file:///a/b")] == ["s3://b/x", "s3://b/x", "abfss://c@a/x", "hdfs://h:9/x", "file:///a/b", "file:///a/b", "file:///a/b"]


def test_flatgeobuf_runs(spark, tmp_path, monkeypatch):
    """Files in runs of a few features; a box leaves most out, by an upper level of the index."""
    rng = random.Random(16)
    pts = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(900)]
    df = frame(spark, [[f"POINT ({x} {y})"] for x, y in pts], [point()])
    path = str(tmp_path / "f")
    flatgeobuf.write_flatgeobuf(df.coalesce(1), path)
    monkeypatch.setattr(flatgeobuf, "RUN", 50)
    monkeypatch.setattr(flatgeobuf, "NODES", 60)
    whole = flatgeobuf.read_flatgeobuf(spark, path)
    assert whole.rdd.getNumPartitions() == 18 and sorted(r.i for r in whole.collect()) == list(range(900))
    near = flatgeobuf.read_flatgeobuf(spark, path, bbox=(2, 3, 3, 3.5))
    assert 1 <= near.rdd.getNumPartitions() < 9 and sorted(r.i for r in near.collect()) == sorted(k for k, (x, y) in enumerate(pts) if 2 <= x <= 3 and 3 <= y <= 3.5)
    assert flatgeobuf.read_flatgeobuf(spark, path, bbox=(20, 20, 30, 30)).count() == 0


def test_flatgeobuf_records_name_their_columns(spark, tmp_path):
    def feature(x, columns, values):
        b = flatgeobuf.Builder()
        return b.finish(b.table({0: ("table", {1: ("vector:d", [x, x])}), 1: ("bytes", flatgeobuf._write_properties(values, columns)), 2: ("tables", [{0: ("text", n), 1: ("B", flatgeobuf.COLUMN_TYPES.index(k))} for n, k in columns])}))

    def write(name, features):
        b = flatgeobuf.Builder()
        head = flatgeobuf.MAGIC + b.finish(b.table({0: ("text", "t"), 2: ("B", 1), 8: ("Q", len(features)), 9: ("H", 0)}))
        (tmp_path / name).write_bytes(head + b"".join(features))
        return str(tmp_path / name)

    rows = [feature(float(k), [("a", "int"), ("b", "string")][k % 2 :], {"a": k, "b": f"v{k}"}) for k in range(6)]
    path = write("x.fgb", rows)
    back = flatgeobuf.read_flatgeobuf(spark, path)
    assert back.columns == ["a", "b", "geometry"] and sorted((r.geometry.x, r.a, r.b) for r in back.collect()) == [(float(k), None if k % 2 else k, f"v{k}") for k in range(6)]
    other = write("y.fgb", [*rows, feature(9.0, [("a", "double")], {"a": 1.5})])
    with pytest.raises(GeoError):
        flatgeobuf.read_flatgeobuf(spark, other, max_scan_records=None)
    late = write("z.fgb", [*rows, feature(9.0, [("c", "int")], {"c": 1})])
    assert flatgeobuf.read_flatgeobuf(spark, late).columns == ["a", "b", "c", "geometry"]
    with pytest.raises(Exception, match="max_scan_records"):
        flatgeobuf.read_flatgeobuf(spark, late, max_scan_records=3).collect()


def test_geoparquet_places_and_row_groups(spark, tmp_path):
    df = frame(spark, [[f"POINT ({k} {k})"] for k in range(40)], [point()])
    path = str(tmp_path / "g")
    geoparquet.write_geoparquet(df.repartitionByRange(4, "i").sortWithinPartitions("i"), path, row_group_size=4, generate_covering=True)
    d = geoparquet.GeoParquetDataset.open(spark, path)
    every = [r.i for r in d.read().select("i").collect()]
    order = [r.i for f in d.files for r in spark.read.parquet(f).collect()]
    assert sorted(every) == list(range(40))
    for offset, limit in ((0, 7), (5, 3), (13, 20), (33, None), (40, 5), (39, 1), (0, 100)):
        got = [r.i for r in d.read(offset=offset, limit=limit).collect()]
        assert sorted(got) == sorted(order[offset:][:limit])
    assert len(d.read(offset=1, limit=2).inputFiles()) == 1
    inside = [i for i in order if 3 <= i <= 30]
    assert [r.i for r in d.read(bbox=(3, 3, 30, 30), offset=4, limit=9).collect()] == inside[4:13]
    groups = [r for f in d.footers for r in f["groups"]]
    assert d.num_row_groups == len(groups) > 8
    some = d.read_row_groups([1, len(groups) - 1])
    at = [0]
    for g in groups:
        at.append(at[-1] + g["rows"])
    assert sorted(r.i for r in some.collect()) == sorted(order[at[1] : at[2]] + order[at[-2] : at[-1]]) and geo(some, "g0").type.kind == "point"
    assert d.read_row_groups([0], columns=["i"]).columns == ["i"] and d.read_row_groups([]).count() == 0


def test_index_of_chunks(spark, tmp_path):
    rng = random.Random(21)
    rows = [[f"LINESTRING ({x} {y}, {x + rng.random()} {y + rng.random()})"] for x, y in ((rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(700))] + [[None], ["LINESTRING EMPTY"]]
    df = frame(spark, rows, [linestring()]).repartition(3)
    index = index_chunks(df, "i", "g0", 100)
    assert index.agg(F.sum("n"), F.max("n")).first()[:] == (700, 100)
    index.write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    for box in ((3, 4, 6, 5), (6, 5, 3, 4), (0, 0, 30, 30), (40, 40, 50, 50)):
        want = sorted(r.i for r in bbox_filter(df, "g0", box).collect())
        assert sorted(r.id for r in search_chunks(stored, box).collect()) == want
    assert index_chunks(df.filter("i < 0"), "i", "g0").count() == 0


class _Shape:
    def __init__(self, wkb):
        self.wkb = wkb


def test_exchange_by_wkb(spark, monkeypatch):
    """With stand-ins for the libraries, which are not there."""
    import sys
    import types

    import pandas as pd

    from tessera import interop
    from tessera.kernels.codecs import from_wkt as read
    from tessera.kernels.codecs import to_wkb

    wkb = [to_wkb(read("POINT (1 2)")), None, to_wkb(read("LINESTRING (0 0, 1 1)"))]
    df = interop.from_shapely(spark, [None if x is None else _Shape(x) for x in wkb], "EPSG:4326", "g")
    assert geo(df).type.crs == "EPSG:4326" and [r.w for r in df.orderBy("place").select(kernel.to_wkt(geo(df)).column.alias("w")).collect()] == ["POINT (1 2)", None, "LINESTRING (0 0, 1 1)"]
    with pytest.raises(GeoError):
        interop.to_shapely(df)

    class Column:
        name = "shape"

        def to_wkb(self):
            return wkb

    class Frame:
        geometry, crs = Column(), types.SimpleNamespace(to_authority=lambda: ("EPSG", "3857"))

        def drop(self, columns):
            assert columns == ["shape"]
            return pd.DataFrame({"a": [1, 2, 3]})

    back = interop.from_geopandas(spark, Frame())
    assert back.columns == ["a", "shape"] and geo(back).type.crs == "EPSG:3857" and back.filter("shape is null").first().a == 2
    monkeypatch.setitem(sys.modules, "shapely", types.SimpleNamespace(from_wkb=_Shape))
    assert [None if s is None else s.wkb for s in interop.to_shapely(df.orderBy("place"))] == wkb
    fake = types.SimpleNamespace(GeoDataFrame=lambda plain, geometry: (list(plain.columns), geometry), GeoSeries=types.SimpleNamespace(from_wkb=lambda v, crs: (list(v), crs)))
    monkeypatch.setitem(sys.modules, "geopandas", fake)
    assert interop.to_geopandas(df.orderBy("place")) == (["place"], (wkb, "EPSG:4326"))
    table = spark.createDataFrame([(1, bytearray(wkb[0]))], "a int, wkb_geometry binary").toArrow()
    monkeypatch.setitem(sys.modules, "pyogrio", types.SimpleNamespace(read_arrow=lambda path: ({"crs": "EPSG:4326"}, table)))
    assert geo(interop.read_pyogrio(spark, "x")).type.kind == "geometry"
