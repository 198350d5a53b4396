"""Growth and right results of what larger tables showed."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import native
from tessera.kernels import arrange, planar
from tessera.kernels.codecs import G
from tessera.types import geo


def test_polylabel_does_not_walk_ridges(monkeypatch):
    """Every point of a rectangle's middle line is as deep: some depths are enough."""
    count, depth = [], planar._depth
    monkeypatch.setattr(planar, "_depth", lambda *a: count.append(a) or depth(*a))
    for w, h in ((4, 1), (1, 5), (3, 3), (2.5, 1.75)):
        p = planar.polylabel(G("polygon", "xy", [[(0.0, 0.0), (w, 0.0), (w, h), (0.0, h), (0.0, 0.0)]]), 0.01).value
        assert min(p[0], w - p[0], p[1], h - p[1]) >= min(w, h) / 2 - 0.01
    assert len(count) < 60


def test_matrix_of_boxes(monkeypatch):
    """Of all ways two upright rectangles lie: the same as from an arrangement."""
    box = lambda x, y, w, h: G("polygon", "xy", [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]])
    a = box(3.0, 3.0, 2.0, 2.0)
    others = [box(float(x), float(y), float(w), float(h)) for x, y, w, h in itertools.product(range(0, 7), range(0, 7), (1, 2, 4), (1, 2, 4))]
    fast = [(arrange.relate(a, b), arrange.relate(b, a)) for b in others]
    with monkeypatch.context() as m:
        m.setattr(arrange, "as_box", lambda g: None)
        assert fast == [(arrange.relate(a, b), arrange.relate(b, a)) for b in others]
    monkeypatch.setattr(arrange, "Arrangement", lambda *a: pytest.fail("an arrangement"))
    assert arrange.relate(a, a) == "2FFF1FFF2"


def test_ring_query_has_its_sqls_rings(spark, tmp_path):
    """A closed line that crosses itself is a ring to the query's SQL, which counts and compares vertices."""
    duckdb = pytest.importorskip("duckdb")
    places = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]
    rows = [(1, 1000 + x, 100 + y, k) for k, (x, y) in enumerate(places)] + [(2, 1, 1, 0), (2, 2, 2, 1), (2, 1, 1, 2)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["geom_is_ring"]).fetchall()
    assert sorted(map(tuple, entry.queries()["geom_is_ring"](spark, str(tmp_path)).collect())) == sorted(want) == [(1, True), (2, False)]


def test_places_around_a_meridian_are_dealt_to_all_cores(spark, tmp_path):
    """A table of one file is no single task where its rows are much work."""
    spark.range(100).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = entry.queries()["geom_reproject_utm"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.count() == 100 and df.filter("back").count() == 100


def test_mixed_parts_are_several_files_a_kind(spark, tmp_path, monkeypatch):
    """A kind of a large table is no single task; each file still holds one kind."""
    from tessera.plans import queries, shapes
    from tessera.sources.geoparquet import GeoParquetDataset

    one = lambda df, name: df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    one(spark.sql("select id c_custkey, 1 c_nationkey, 1D c_acctbal from range(200)"), "customer")
    one(spark.sql("select id s_suppkey, 1 s_nationkey from range(50)"), "supplier")
    one(spark.sql("select id div 3 l_orderkey, id l_partkey, id l_suppkey, cast(id % 3 as int) l_linenumber from range(900)"), "lineitem")
    size = int(shapes.table(spark, str(tmp_path), "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(queries, "_KIND_BYTES", size // 3)
    monkeypatch.setattr(queries.s, "workspace", lambda *a: f"file://{tmp_path}/out")
    got = {r.kind: r.n for r in entry.queries()["geoparquet_mixed_parts"](spark, str(tmp_path)).collect()}
    assert got == {0: 3, 1: 197, 2: 300, 3: 50}
    found = GeoParquetDataset.open(spark, f"file://{tmp_path}/out")
    kinds = [m.columns["g"]["geometry_types"] for m in found.metas]
    assert all(len(k) < 2 for k in kinds) and sum(k == ["LineString"] for k in kinds) == 3


def test_insets_without_overlays(monkeypatch):
    """Rings that only move in are what overlays of pieces leave; what splits or loses edges goes by overlays."""
    area = lambda g: sum(abs(arrange.ring_area2(r)) / 2 * (1 if k == 0 else -1) for p in g.value for k, r in enumerate(p))
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    waist = [(0.0, 0.0), (4.0, 1.9), (8.0, 0.0), (8.0, 4.0), (4.0, 2.1), (0.0, 4.0)]
    rng, cases = random.Random(11), [(ell, 0.2), (ell[::-1], 0.3), (ell, 0.6), (waist, 0.2)]
    while len(cases) < 24:
        spokes = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 8)))
        ring = [(r * math.cos(t), r * math.sin(t)) for t in spokes for r in [rng.uniform(1, 6)]]
        if planar.invalid_reason(G("polygon", "xy", [[*ring, ring[0]]])) == planar.VALID:
            cases.append((ring, rng.choice((0.05, 0.2, 0.6))))
    shapes = [(G("polygon", "xy", [[*ring, ring[0]]]), w) for ring, w in cases]
    fast = [planar.buffer(g, -w) for g, w in shapes]
    with monkeypatch.context() as m:
        m.setattr(planar, "_inset", lambda *a: None)
        for (g, w), got in zip(shapes, fast, strict=True):
            assert area(got) == pytest.approx(area(planar.buffer(g, -w)), rel=1e-9, abs=1e-9)
    assert fast[2].value == [] and len(fast[3].value) == 2
    monkeypatch.setattr(planar, "overlay", lambda *a: pytest.fail("an overlay"))
    assert len(planar.buffer(shapes[0][0], -0.2).value) == len(planar.buffer(shapes[1][0], -0.3).value) == 1


def test_centroids_sum_once(spark):
    """Legs are summed once, and vertices only where there is no length; what has no place stays null."""
    df = spark.sql("select k, transform(v, x -> named_struct('x', x, 'y', 2 * x)) g from values (0, array(0D, 4D, 4D)), (1, array(3D, 3D)), (2, array(double('nan'))), (3, cast(array() as array<double>)), (4, null) t(k, v)")
    c = native.centroid(native.make_geometry("linestring", F.col("g"))).column
    out = df.select("k", c["x"].alias("x"), c["y"].alias("y"))
    assert {r.k: (r.x, r.y) for r in out.collect()} == {0: (2.0, 4.0), 1: (3.0, 6.0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2


def test_densifying_repeats_its_leg_only(spark):
    """Vertices of a leg come from its copies and their places; no second array goes along."""
    df = spark.sql("select array(named_struct('x', 0D, 'y', 0D, 'z', 1D), named_struct('x', 3D, 'y', 4D, 'z', 2D), named_struct('x', 3D, 'y', 4D, 'z', 2D)) g")
    d = native.densify(native.make_geometry("linestring", F.col("g"), "xyz"), 2.5)
    assert [tuple(v) for v in df.select(d.column.alias("v")).first().v] == [(0, 0, 1), (1.5, 2, 1.5), (3, 4, 2), (3, 4, 2)]
    assert "sequence(" not in df.select(d.column)._jdf.queryExecution().analyzed().toString()


def test_text_of_lines_by_batches():
    """Whole batches of lines as text, and back, are what rows give one by one; what is not plain goes row by row."""
    import pyarrow as pa

    from tessera.functions import kernel
    from tessera.kernels import codecs, wkb
    from tessera.types import linestring

    rng, t = random.Random(1), linestring()
    rows = [G("linestring", "xy", [(float(rng.randint(-5, 999)), rng.choice((-0.0, 7.0, 1e9))) for _ in range(rng.randint(1, 7))]) for _ in range(300)]
    lines, words = kernel.encode(rows, t), pa.array([codecs.to_wkt(r) for r in rows])
    assert wkb.lines_to_text(lines).equals(words) and wkb.lines_to_text(lines.slice(40, 9)).equals(words.slice(40, 9))
    assert kernel.decode(wkb.lines_from_text(words.slice(40, 9)).cast(lines.type), t) == rows[40:49]
    odd = [G("linestring", "xy", [(rng.uniform(-1e3, 1e3), -0.1), (1.5, 2.0)]) for _ in range(99)]
    assert kernel.decode(wkb.lines_from_text(pa.array([codecs.to_wkt(r) for r in odd])).cast(lines.type), t) == odd
    for r in ([None, rows[0]], [G("linestring", "xy", [])], odd, [G("linestring", "xy", [(1e15, 0.0)])], [G("linestring", "xy", [(float("nan"), 0.0)])]):
        assert wkb.lines_to_text(kernel.encode(r, t)) is None
    for w in ("LINESTRING EMPTY", "linestring (0 0, 1 1)", "LINESTRING (0 0 0, 1 1 1)", "LINESTRING (0 1e3, 1 1)", "LINESTRING (0 \u0661, 1 1)", "POINT (1 1)", "LINESTRING (0 0, 1 1) ", None):
        assert wkb.lines_from_text(pa.array(["LINESTRING (0 0, 1 1)", w])) is None
