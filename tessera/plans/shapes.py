"""Geometries made from the business tables by integer arithmetic: the same numbers in any engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import native
from tessera.operators.join import spread
from tessera.types import Geo, linestring, multipoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); in local runs a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, c_nationkey, c_acctbal and a point g."""
    g = native.make_point(F.expr("(c_custkey * 7919) % 36000 / 100.0D - 180"), F.expr("(c_custkey * 104729) % 18000 / 100.0D - 90"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", g.alias("g"))


def some_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers with nulls at multiples of 97."""
    df = customers(spark, sf_dir)
    return df.withColumn("g", Geo(F.when(F.col("c_custkey") % 97 != 0, F.col("g")), native.make_point(0.0, 0.0).type).alias("g"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = native.make_point(F.expr("(event_id * 31 + user_id * 17) % 3600 / 10.0D - 180"), F.expr("(event_id * 13 + user_id * 7) % 1800 / 10.0D - 90"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", g.alias("g"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, n_regionkey, n_name and a cell of 72 by 36 degrees."""
    x, y = F.expr("n_nationkey % 5 * 72.0D - 180"), F.expr("(n_nationkey div 5) * 36.0D - 90")
    cell = native.box_to_polygon(native.make_box(x, y, x + 72.0, y + 36.0))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name", cell.alias("cell"))


#: An L of seven vertices.
ELL = ((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_suppkey, s_nationkey and an L-shaped polygon g, scaled and moved by the key."""
    f = F.expr("1 + s_suppkey % 5")
    ring = F.array(*[vertex(f * x + F.expr("s_suppkey % 100"), f * y + F.expr("s_suppkey % 50")) for x, y in ELL])
    g = native.make_geometry("polygon", F.array(ring))
    return spread(table(spark, sf_dir, "supplier")).select("s_suppkey", "s_nationkey", g.alias("g"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and a line g through its parts and suppliers; of two vertices at least."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items")).filter(F.size("items") >= 2)
    g = native.make_geometry("linestring", F.transform("items", lambda v: vertex(v["l_partkey"] % 1000, v["l_suppkey"] % 100)))
    return df.select("l_orderkey", g.alias("g"))


def short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and a line g in degrees: the same vertices in a tenth."""
    df = order_lines(spark, sf_dir)
    g = Geo(F.transform("g", lambda v: vertex(v["x"] / 10.0 - 50.0, v["y"] / 10.0)), linestring())
    return df.select("l_orderkey", g.alias("g"))


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_nationkey and the multipoint g of its customers, in order of their keys."""
    df = customers(spark, sf_dir).groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "g"))).alias("v"))
    return df.select("c_nationkey", Geo(F.col("v.g"), multipoint()).alias("g"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and two rectangles with whole corners, a and b, as boxes and polygons."""

    def rect(x: str, y: str, w: str, h: str) -> Geo:
        x, y, w, h = (F.expr(v).cast("double") for v in (x, y, w, h))
        return native.make_box(x, y, x + w, y + h)

    a = rect("p_partkey % 10", "p_partkey % 7", "1 + p_size % 4", "1 + p_partkey % 5")
    b = rect("p_partkey * 7 % 11", "p_partkey * 3 % 8", "1 + p_partkey % 3", "1 + p_size % 5")
    df = spread(table(spark, sf_dir, "part"))
    return df.select("p_partkey", a.alias("box_a"), b.alias("box_b"), native.box_to_polygon(a).alias("a"), native.box_to_polygon(b).alias("b"))


#: The same in DuckDB: rows named ax0, ay0, ax1, ay1 and bx0 and so on.
SQL_RECTANGLES = """rect AS (SELECT p_partkey, ax0, ay0, ax0 + aw AS ax1, ay0 + ah AS ay1, bx0, by0, bx0 + bw AS bx1, by0 + bh AS by1 FROM (
  SELECT p_partkey, (p_partkey % 10)::DOUBLE AS ax0, (p_partkey % 7)::DOUBLE AS ay0, (1 + p_size % 4)::DOUBLE AS aw, (1 + p_partkey % 5)::DOUBLE AS ah,
         (p_partkey * 7 % 11)::DOUBLE AS bx0, (p_partkey * 3 % 8)::DOUBLE AS by0, (1 + p_partkey % 3)::DOUBLE AS bw, (1 + p_size % 5)::DOUBLE AS bh FROM part)),
meet AS (SELECT *, ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1 AS hit, ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1 AS deep,
  ax0 <= bx0 AND ax1 >= bx1 AND ay0 <= by0 AND ay1 >= by1 AS holds, bx0 <= ax0 AND bx1 >= ax1 AND by0 <= ay0 AND by1 >= ay1 AS held,
  greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) AS common,
  (ax1 - ax0) * (ay1 - ay0) AS area_a, (bx1 - bx0) * (by1 - by0) AS area_b FROM rect)"""

SQL_CUSTOMERS = """cust AS (SELECT c_custkey, c_nationkey, c_acctbal, (c_custkey * 7919) % 36000 / 100.0::DOUBLE - 180 AS x, (c_custkey * 104729) % 18000 / 100.0::DOUBLE - 90 AS y FROM customer)"""

SQL_EVENTS = """ev AS (SELECT event_id, user_id, event_type, (event_id * 31 + user_id * 17) % 3600 / 10.0::DOUBLE - 180 AS x, (event_id * 13 + user_id * 7) % 1800 / 10.0::DOUBLE - 90 AS y FROM events)"""

SQL_NATIONS = """cells AS (SELECT n_nationkey, n_regionkey, n_name, n_nationkey % 5 * 72.0::DOUBLE - 180 AS x0, (n_nationkey // 5) * 36.0::DOUBLE - 90 AS y0, x0 + 72 AS x1, y0 + 36 AS y1 FROM nation)"""

#: Lines as lists xs and ys, n vertices; steps: one row a step, in order k.
SQL_LINES = """lines AS (SELECT l_orderkey, list((l_partkey % 1000)::DOUBLE ORDER BY l_linenumber, l_partkey, l_suppkey) AS xs, list((l_suppkey % 100)::DOUBLE ORDER BY l_linenumber, l_partkey, l_suppkey) AS ys, count(*) AS n
  FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2)"""

SQL_ELLS = """ells AS (SELECT s_suppkey, (1 + s_suppkey % 5)::DOUBLE AS f, (s_suppkey % 100)::DOUBLE AS ox, (s_suppkey % 50)::DOUBLE AS oy FROM supplier)"""

