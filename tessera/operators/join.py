"""Spatial joins by grid cells.

A condition on places cannot be an equi-join, and a nested loop compares
everything with everything. So both sides' boxes are dealt to the cells of a
grid that they meet and the cells are joined: an equi-join that Spark can
shuffle, broadcast or split where one cell is hot. A pair is kept only in the
cell that holds the lower left corner of the boxes' common part: no pair comes
twice, without another shuffle. Boxes are compared before the exact predicate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as st
from tessera.functions import native
from tessera.types import Geo, GeoError, free_name, geo

Predicate = Callable[[Geo, Geo], Column]


#: Rows of the right side that a cell should hold where they lie closest.
CELL_ROWS = 64


def cell_size(df: DataFrame, g: Geo, rows: int = CELL_ROWS) -> float:
    """A cell's width: as wide as the average box, or, for boxes that are small for how close they lie, as holds some rows where they lie closest.

    A few passes that give some numbers: the extent, and how many rows the
    average row shares its cell with, in a coarse grid and in finer ones while
    these are many. There is no least share of the extent: a town in a world
    table has cells of its own size.
    """
    b = native.bounding_rect(g).column
    s = df.agg(F.min(b["xmin"]), F.max(b["xmax"]), F.min(b["ymin"]), F.max(b["ymax"]), F.avg(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])), F.count(b)).first()
    if s[0] is None:
        return 1.0
    span, mean, n = max(s[1] - s[0], s[3] - s[2]), s[4], s[5]
    if not (span > 0 and math.isfinite(span)):
        return 1.0
    size = max(mean, span / 256)
    for _ in range(3):  # finer cells show where rows lie closer still
        if not (size > mean and n > rows):
            break
        # how many rows the average row has in its cell
        full = df.filter(b["xmin"].isNotNull()).groupBy(F.floor(b["xmin"] / size).alias("x"), F.floor(b["ymin"] / size).alias("y")).agg(F.count("*").alias("n"))
        close = full.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if close <= 2 * rows:
            break
        size = max(mean, size / math.sqrt(close / rows))
    return size if size > 0 else span


def _levels(width: Column, size: float, levels: int) -> Column:
    """How many times a cell is doubled until it is as wide as the box."""
    return F.least(F.lit(levels), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width / size, F.lit(1.0)))))).cast("int")


def _cells(b: Column, size: float, level: Column) -> Column:
    """The cells of a level that a box meets: four at most if the cells are as wide as the box."""
    w = F.lit(size) * F.pow(F.lit(2.0), level)
    at = lambda v: F.floor(v / w).cast("long")
    xs, ys = F.sequence(at(b["xmin"]), at(b["xmax"])), F.sequence(at(b["ymin"]), at(b["ymax"]))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _dealt(df: DataFrame, b: Column, name: str, grow: float = 0.0) -> DataFrame:
    box = F.struct((b["xmin"] - grow).alias("xmin"), (b["ymin"] - grow).alias("ymin"), (b["xmax"] + grow).alias("xmax"), (b["ymax"] + grow).alias("ymax"))
    return df.withColumn(f"{name}box", F.when(b.isNotNull(), box)).filter(F.col(f"{name}box").isNotNull())


#: Input of fewer bytes a core is dealt to all cores before pairs are tested; larger input has row groups, and so tasks, enough.
SPREAD_BYTES = 32 << 20
#: Bytes of what is dealt out that make a task; at least one a core.
TASK_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small: a small file, or one row group, is one task, but its rows or pairs may be much work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(cores, size // TASK_BYTES)) if size < cores * SPREAD_BYTES else df


def candidates(left: DataFrame, left_geo: Geo, right: DataFrame, right_geo: Geo, size: float | None = None, grow: float = 0.0) -> DataFrame:
    """All columns of both sides for the pairs whose boxes, the left one grown, overlap or touch; each pair once.

    size: width of a cell; from the right side's boxes if not given. Boxes
    wider than a cell use coarser grids, cells doubling by level, so that each
    box meets four cells at most; the other side is dealt to the cells of
    those levels that occur.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise GeoError(f"rename columns that both sides have: {', '.join(sorted(clash))}")
    size = size or cell_size(right, right_geo)
    l, r = (f"{free_name(left, right)}{side}" for side in "lr")  # noqa: E741
    a = _dealt(spread(left), native.bounding_rect(left_geo).column, l, grow)
    b = _dealt(right, native.bounding_rect(right_geo).column, r)
    width = lambda c: F.greatest(c["xmax"] - c["xmin"], c["ymax"] - c["ymin"])
    p, q = F.col(f"{l}box"), F.col(f"{r}box")
    own_a, own_b = _levels(width(p), size, 40), _levels(width(q), size, 40)
    # a pair meets at the level of the wider of the two
    # points are as wide as the first level; for others one job tells which of the 40 levels occur
    sides = [d.select(own.alias("k")) for d, own, g in ((a, own_a, left_geo), (b, own_b, right_geo)) if g.type.kind != "point" or (grow and g is left_geo)]
    levels = sorted({0} | {x[0] for d in [sides[0].unionAll(sides[-1])] for x in d.distinct().collect()}) if sides else [0]
    every = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")

    def deal(d: DataFrame, own: Column, name: str, is_point: bool) -> DataFrame:
        d = d.withColumn(f"{name}own", F.lit(0) if is_point else own)
        if levels == [0]:
            d = d.withColumn(f"{name}level", F.lit(0))
        else:
            d = d.withColumn(f"{name}level", F.explode(F.filter(every, lambda k: k >= F.col(f"{name}own"))))
        if is_point:  # a point is in one cell of a level
            w = F.lit(size) * F.pow(F.lit(2.0), F.col(f"{name}level"))
            return d.withColumn(f"{name}x", F.floor(F.col(f"{name}box.xmin") / w).cast("long")).withColumn(f"{name}y", F.floor(F.col(f"{name}box.ymin") / w).cast("long"))
        d = d.withColumn(f"{name}c", F.explode(_cells(F.col(f"{name}box"), size, F.col(f"{name}level"))))
        return d.withColumn(f"{name}x", F.col(f"{name}c.cx")).withColumn(f"{name}y", F.col(f"{name}c.cy"))

    a, b = deal(a, own_a, l, left_geo.type.kind == "point" and not grow), deal(b, own_b, r, right_geo.type.kind == "point")
    joined = a.join(b, (F.col(f"{l}level") == F.col(f"{r}level")) & (F.col(f"{l}x") == F.col(f"{r}x")) & (F.col(f"{l}y") == F.col(f"{r}y")))
    w = F.lit(size) * F.pow(F.lit(2.0), F.col(f"{l}level"))
    first = (F.floor(F.greatest(p["xmin"], q["xmin"]) / w) == F.col(f"{l}x")) & (F.floor(F.greatest(p["ymin"], q["ymin"]) / w) == F.col(f"{l}y"))
    overlap = (p["xmax"] >= q["xmin"]) & (p["ymax"] >= q["ymin"]) & (p["xmin"] <= q["xmax"]) & (p["ymin"] <= q["ymax"])
    out = joined.filter((F.col(f"{l}level") == F.greatest(f"{l}own", f"{r}own")) & overlap & first)
    return out.select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)])


def _named(df: DataFrame, name: str) -> Geo:
    return geo(df, name)


def _test(predicate: Predicate | str) -> Predicate:
    return predicate if callable(predicate) else {"intersects": st.intersects, "contains": st.contains, "within": st.within}.get(predicate) or getattr(st.kernel, predicate)


def spatial_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, predicate: Predicate | str = "intersects", how: str = "inner", size: float | None = None) -> DataFrame:
    """Join on a predicate of two geometry columns that only holds where boxes meet: intersects, contains, within, covers and so on.

    how: inner, left, semi or anti. For left rows of left are told apart by a
    number that is given here, so left must be deterministic. For semi and anti
    different geometries are tested, each once. Null and empty geometries match
    nothing.
    """
    test = _test(predicate)
    if how in ("semi", "anti"):
        hits, a, _ = _hits(left, right, left_on, right_on, test, size)
        return left.join(hits.select(a).distinct(), F.col(f"`{left_on}`") == F.col(a), f"left_{how}")
    row = f"{free_name(left, right)}row"
    if how != "inner":
        left = left.withColumn(row, F.monotonically_increasing_id())
    pairs = candidates(left, _named(left, left_on), right, _named(right, right_on), size)
    hits = pairs.filter(test(_typed(pairs, left, left_on), _typed(pairs, right, right_on)))
    if how == "inner":
        return hits
    if how == "left":
        return left.join(hits.select(row, *[F.col(f"`{c}`") for c in right.columns]), row, "left").drop(row)
    raise GeoError(f"unknown kind of join {how!r}")


def _once(df: DataFrame, g: Geo, name: str) -> DataFrame:
    """The different geometries of df, those with a place, in a column name, with how many rows have each in a column name + n."""
    return df.select(g.alias(name)).groupBy(name).agg(F.count("*").alias(f"{name}n")).select(Geo(F.col(name), g.type).alias(name), f"{name}n").filter(F.col(name).isNotNull())


def _hits(left: DataFrame, right: DataFrame, left_on: str, right_on: str, test: Predicate, size: float | None) -> tuple[DataFrame, str, str]:
    """Pairs of different geometries that pass the test, with how many rows of each side have them: rows that share a geometry share what it meets."""
    own = free_name(left, right)
    a, b = f"{own}a", f"{own}b"
    p, q = _once(left, _named(left, left_on), a), _once(right, _named(right, right_on), b)
    pairs = candidates(p, geo(p, a), q, geo(q, b), size)
    return pairs.filter(test(_typed(pairs, p, a), _typed(pairs, q, b))), a, b


def count_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, predicate: Predicate | str = "intersects", size: float | None = None) -> DataFrame:
    """The rows of right that the predicate holds for with some row of left, and with how many in a column n: the inner join counted by right's rows, without a row for each pair."""
    if "n" in right.columns:
        raise GeoError("rename the column n: the result has one")
    hits, _, b = _hits(left, right, left_on, right_on, _test(predicate), size)
    n = hits.groupBy(b).agg(F.sum(f"{b[:-1]}an").alias("n"))
    return right.join(n, F.col(f"`{right_on}`") == F.col(b)).drop(b)


def _typed(df: DataFrame, source: DataFrame, name: str) -> Geo:
    return Geo(df[name], geo(source, name).type)


def distance_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, radius: float, size: float | None = None) -> DataFrame:
    """Pairs at most radius apart, with their distance."""
    pairs = candidates(left, _named(left, left_on), right, _named(right, right_on), size, radius)
    if "distance" in pairs.columns:
        raise GeoError("rename the column distance: the result has one")
    return pairs.withColumn("distance", st.distance(_typed(pairs, left, left_on), _typed(pairs, right, right_on))).filter(F.col("distance") <= radius)


def bbox_filter(df: DataFrame, name: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose box overlaps or touches bbox (xmin, ymin, xmax, ymax; swapped corners are put right)."""
    x0, y0, x1, y1 = bbox
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    g = geo(df, name)
    b = native.bounding_rect(g).column
    return df.filter((b["xmax"] >= x0) & (b["ymax"] >= y0) & (b["xmin"] <= x1) & (b["ymin"] <= y1))
