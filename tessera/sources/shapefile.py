"""Shapefiles: shapes from .shp, attributes from the .dbf beside it. One task reads one pair of files."""

from __future__ import annotations

import datetime
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import kernel
from tessera.kernels.codecs import G, to_wkb
from tessera.sources.geoparquet import _arrow_fs
from tessera.sources.paths import list_files, read_bytes
from tessera.types import Geo, GeoError, GeoType

#: Shape type modulo 10: what it reads as.
_KINDS = {1: "point", 3: "multilinestring", 5: "multipolygon", 8: "multipoint"}


def shape_type(head: bytes) -> GeoType:
    (code,) = struct.unpack_from("<i", head, 32)
    kind = _KINDS.get(code % 10)
    if kind is None:
        raise GeoError(f"shape type {code} is not supported")
    return GeoType(kind, ("xy", "xyzm", "xym")[code // 10] if code // 10 != 1 else "xyz")


def _area(r: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))


def _inside(p: tuple, r: list) -> bool:
    odd = False
    for a, b in zip(r, r[1:]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def read_shape(d: bytes, dim: str) -> G | None:
    """One record's content; null shapes are null. Rings that run clockwise are shells, others holes of the smallest shell around them."""
    (code,) = struct.unpack_from("<i", d, 0)
    if code == 0:
        return None
    kind, extra = _KINDS[code % 10], len(dim) - 2
    if kind == "point":
        return G(kind, dim, struct.unpack_from(f"<{2 + extra}d", d, 4))
    if kind == "multipoint":
        (n,) = struct.unpack_from("<i", d, 36)
        parts, at = [0], 40
    else:
        k, n = struct.unpack_from("<ii", d, 36)
        parts, at = list(struct.unpack_from(f"<{k}i", d, 44)), 44 + 4 * k
    xy = struct.unpack_from(f"<{2 * n}d", d, at)
    at += 16 * n
    axes = [xy[::2], xy[1::2]]
    for _ in range(extra):  # a range of two numbers comes before each further axis; m may be missing
        axes.append(struct.unpack_from(f"<{n}d", d, at + 16) if at + 16 + 8 * n <= len(d) else (float("nan"),) * n)
        at += 16 + 8 * n
    vs = list(zip(*axes, strict=True))
    if kind == "multipoint":
        return G(kind, dim, vs)
    lines = [vs[a:b] for a, b in zip(parts, [*parts[1:], n])]
    if kind == "multilinestring":
        return G(kind, dim, lines)
    shells = [[r] for r in lines if _area(r) < 0] or [[r] for r in lines[:1]]
    used = {id(s[0]) for s in shells}
    for r in lines:
        if id(r) not in used:
            around = [s for s in shells if _inside(r[0], s[0])] or shells[:1]
            min(around, key=lambda s: abs(_area(s[0]))).append(r)
    return G(kind, dim, shells)


@dataclass
class _Column:
    name: str
    code: str
    at: int
    size: int
    decimals: int

    @property
    def type(self) -> T.DataType:
        return {"C": T.StringType(), "N": T.LongType() if self.decimals == 0 and self.size <= 18 else T.DoubleType(), "F": T.DoubleType(), "O": T.DoubleType(), "I": T.IntegerType(), "L": T.BooleanType(), "D": T.DateType(), "T": T.TimestampNTZType(), "@": T.TimestampNTZType()}.get(self.code, T.StringType())

    def value(self, row: bytes, encoding: str):
        raw = row[self.at : self.at + self.size]
        if self.code == "I":
            return struct.unpack("<i", raw)[0]
        if self.code == "O":
            return struct.unpack("<d", raw)[0]
        if self.code in "T@":  # days since the Julian epoch and milliseconds: microseconds in the column
            day, ms = struct.unpack("<ii", raw)
            return datetime.datetime(1970, 1, 1) + datetime.timedelta(days=day - 2440588, milliseconds=ms) if day else None
        text = raw.decode(encoding, "replace").strip(" \0")
        if not text or set(text) == {"*"}:
            return None if self.code != "C" else (text or None)
        if self.code in "NF":
            return int(text) if isinstance(self.type, T.LongType) else float(text)
        if self.code == "L":
            return True if text in "YyTt" else False if text in "NnFf" else None
        if self.code == "D":
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        return text


def dbf_columns(head: bytes) -> list[_Column]:
    out, at, k = [], 1, 32
    while k + 32 <= len(head) and head[k] != 0x0D:
        name = head[k : k + 11].split(b"\0")[0].decode("latin-1")
        out.append(_Column(name, chr(head[k + 11]), at, head[k + 16], head[k + 17]))
        at += head[k + 16]
        k += 32
    return out


@dataclass
class _Pair(InputPartition):
    shp: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.wanted = options, schema

    def partitions(self) -> list[InputPartition]:
        return [_Pair(f) for f in json.loads(self.options["files"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema, rows = to_arrow_schema(self.wanted), []
        fs, path = _arrow_fs(partition.shp)
        dim, encoding = self.options["dim"], self.options["encoding"]
        with fs.open_input_file(path) as shp, fs.open_input_file(path[:-4] + ".dbf") as dbf:
            head = dbf.read(32)
            skip, size = struct.unpack_from("<HH", head, 8)
            columns = dbf_columns(head + dbf.read(skip - 32))
            shp.seek(100)
            while len(top := shp.read(8)) == 8:
                shape = shp.read(2 * struct.unpack(">i", top[4:])[0])
                row = dbf.read(size)
                g = read_shape(shape, dim)
                if row[:1] == b"*":  # deleted
                    continue
                rows.append({c.name: c.value(row, encoding) for c in columns} | {"geometry": None if g is None else to_wkb(g)})
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_shapefile"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def read_shapefile(spark: SparkSession, paths: str | list[str], crs: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """The rows of shapefiles of one type and with the same columns. Lines and polygons read as their multi-part kinds."""
    files = list_files(spark, paths, ".shp")
    if not files:
        raise GeoError("no shapefiles")
    kinds = {shape_type(read_bytes(spark, f, 100)) for f in files}
    if len(kinds) != 1:
        raise GeoError("files differ in shape type")
    t = kinds.pop()
    heads = []
    for f in files:
        head = read_bytes(spark, f[:-4] + ".dbf", 32)
        heads.append([(c.name, c.type) for c in dbf_columns(read_bytes(spark, f[:-4] + ".dbf", struct.unpack_from("<H", head, 8)[0]))])
    if any(h != heads[0] for h in heads):
        raise GeoError("files differ in columns")
    schema = T.StructType([T.StructField(n, k) for n, k in heads[0]] + [T.StructField("geometry", T.BinaryType())])
    spark.dataSource.register(ShapefileSource)
    df = spark.read.format("tessera_shapefile").options(files=json.dumps(files), schema=schema.json(), dim=t.dim, encoding=encoding).load()
    t = t.with_crs(crs, "authority_code" if crs else None)
    return df.withColumn("geometry", Geo(kernel.from_wkb(F.col("geometry"), t).column, t).alias("geometry"))
