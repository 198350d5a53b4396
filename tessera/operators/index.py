"""Chunks of rows with a packed R-tree each, as a table.

Rows are packed into chunks where they lie; each chunk is a row that holds its
box, a tree over its rows' boxes and the rows' ids in the tree's order. A
window first passes over chunks by their boxes, which Parquet statistics can
do when the table is written, then walks the trees of the others. Joins do not
need this: they use grid cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernel, native
from tessera.sources.flatgeobuf import hilbert, pack_index, search
from tessera.sources.geoparquet import bounds_of
from tessera.types import geo

#: Rows of a chunk and children of a node.
CHUNK_ROWS, NODE_SIZE = 65_536, 16
_SCHEMA = "xmin double, ymin double, xmax double, ymax double, n int, tree binary, ids array<long>"


def _place(box: tuple, whole: tuple) -> int:
    at = lambda low, high, start, end: int(65535 * ((low + high) / 2 - start) / (end - start)) if end > start else 0
    return hilbert(at(box[0], box[2], whole[0], whole[2]), at(box[1], box[3], whole[1], whole[3]))


def index_chunks(df: DataFrame, id: str, name: str | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """xmin, ymin, xmax, ymax, n, tree and ids for each chunk of at most so many rows of df with a box; id: a column of whole numbers. Null and empty geometries are in no chunk."""
    g = geo(df, name)
    b = native.bounding_rect(g).column if g.type.native or g.type.kind == "box" else bounds_of(g if g.type.kind != "wkt" else kernel.to_wkb(g))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, int]] = []

        def chunk() -> pa.RecordBatch:
            boxes = [x for x, _ in held]
            whole = min(x[0] for x in boxes), min(x[1] for x in boxes), max(x[2] for x in boxes), max(x[3] for x in boxes)
            held.sort(key=lambda x: _place(x[0], whole))
            tree, ids = pack_index([x for x, _ in held], list(range(len(held))), NODE_SIZE), [i for _, i in held]
            held.clear()
            return pa.record_batch([*(pa.array([v], pa.float64()) for v in whole), pa.array([len(ids)], pa.int32()), pa.array([tree], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["xmin", "ymin", "xmax", "ymax", "n", "tree", "ids"])

        for batch in batches:
            columns = [x.to_pylist() for x in batch.columns]
            for i, *box in zip(*columns, strict=True):
                held.append((tuple(box), i))
                if len(held) >= rows:
                    yield chunk()
        if held:
            yield chunk()

    boxes = df.select(F.col(f"`{id}`").cast("long").alias("id"), b.alias("b")).filter("id is not null and b.xmin <= b.xmax")
    return boxes.select("id", "b.xmin", "b.ymin", "b.xmax", "b.ymax").mapInArrow(run, _SCHEMA)


def search_chunks(index: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """id of every row in index whose box overlaps or touches bbox (swapped corners are put right)."""
    x0, y0, x1, y1 = min(bbox[0], bbox[2]), min(bbox[1], bbox[3]), max(bbox[0], bbox[2]), max(bbox[1], bbox[3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, tree, ids in zip(*(x.to_pylist() for x in b.columns), strict=True):
                yield pa.record_batch([pa.array([ids[k] for k in search(tree, n, NODE_SIZE, (x0, y0, x1, y1))], pa.int64())], ["id"])

    near = index.filter((F.col("xmax") >= x0) & (F.col("ymax") >= y0) & (F.col("xmin") <= x1) & (F.col("ymin") <= y1))
    return near.select("n", "tree", "ids").mapInArrow(run, "id long")
