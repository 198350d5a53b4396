"""FlatGeobuf files: reading with an index search by box, and writing with a packed index.

The file is magic bytes, a header, an optional packed R-tree and features,
header and features being flatbuffers. Files are read by a Python data source.
A file with an index is read in runs of features, each a partition, which
finds the places of its features in its part of the index's leaves. For a box
the driver reads one upper level of the index, some thousand nodes at most,
and only runs below nodes that meet the box become partitions. A file without
an index is one partition.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import kernel
from tessera.kernels.codecs import G, from_wkb, to_wkb, vertices
from tessera.sources.geoparquet import THREADS, _arrow_fs, _Done
from tessera.sources.paths import delete, exists, list_files, read_range
from tessera.types import KINDS, Geo, GeoError, GeoType, geo, geometry_columns

MAGIC = b"fgb\x03fgb\x00"
#: Column types by code.
COLUMN_TYPES = ("byte", "ubyte", "bool", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "string", "json", "datetime", "binary")
_FORMAT = {"byte": "b", "ubyte": "B", "bool": "?", "short": "h", "ushort": "H", "int": "i", "uint": "I", "long": "q", "ulong": "Q", "float": "f", "double": "d"}
_SPARK = {"byte": T.ByteType(), "ubyte": T.ShortType(), "bool": T.BooleanType(), "short": T.ShortType(), "ushort": T.IntegerType(), "int": T.IntegerType(), "uint": T.LongType(), "long": T.LongType(), "ulong": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "json": T.StringType(), "datetime": T.TimestampNTZType(), "binary": T.BinaryType()}


# flatbuffers, as much of them as is needed


class Table:
    """A flatbuffer table: fields by number."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    @staticmethod
    def root(data: bytes) -> Table:
        return Table(data, struct.unpack_from("<I", data, 0)[0])

    def _place(self, k: int) -> int:
        slot = 4 + 2 * k
        off = struct.unpack_from("<H", self.data, self.vtable + slot)[0] if slot < self.size else 0
        return self.at + off if off else 0

    def number(self, k: int, fmt: str, default: Any = 0) -> Any:
        p = self._place(k)
        return struct.unpack_from("<" + fmt, self.data, p)[0] if p else default

    def _ref(self, k: int) -> int:
        p = self._place(k)
        return p + struct.unpack_from("<I", self.data, p)[0] if p else 0

    def text(self, k: int) -> str | None:
        p = self._ref(k)
        return None if not p else self.data[p + 4 : p + 4 + struct.unpack_from("<I", self.data, p)[0]].decode()

    def vector(self, k: int, fmt: str) -> tuple:
        p = self._ref(k)
        return struct.unpack_from(f"<{struct.unpack_from('<I', self.data, p)[0]}{fmt}", self.data, p + 4) if p else ()

    def raw(self, k: int) -> bytes:
        p = self._ref(k)
        return self.data[p + 4 : p + 4 + struct.unpack_from("<I", self.data, p)[0]] if p else b""

    def table(self, k: int) -> Table | None:
        p = self._ref(k)
        return Table(self.data, p) if p else None

    def tables(self, k: int) -> list[Table]:
        p = self._ref(k)
        if not p:
            return []
        n = struct.unpack_from("<I", self.data, p)[0]
        return [Table(self.data, q + struct.unpack_from("<I", self.data, q)[0]) for q in range(p + 4, p + 4 + 4 * n, 4)]


class Builder:
    """Writes tables forwards: each object after those that refer to it, references patched in."""

    def __init__(self) -> None:
        self.out = bytearray(4)

    def _align(self, n: int) -> None:
        self.out += b"\0" * (-len(self.out) % n)

    def table(self, fields: dict[int, tuple[str, Any]]) -> int:
        """fields: number to (kind, value); kind: a struct format, text, bytes, table (a dict), tables, or vector:<format>."""
        top = max(fields, default=-1) + 1
        self._align(2)
        vtable = len(self.out)
        self.out += bytes(4 + 2 * top)
        self._align(8)
        at = len(self.out)
        self.out += struct.pack("<i", at - vtable)
        later = []
        for k, (kind, value) in fields.items():
            if len(kind) == 1:
                self._align(struct.calcsize("<" + kind))
                place = len(self.out)
                self.out += struct.pack("<" + kind, value)
            else:
                self._align(4)
                place = len(self.out)
                self.out += bytes(4)
                later.append((place, kind, value))
            struct.pack_into("<H", self.out, vtable + 4 + 2 * k, place - at)
        struct.pack_into("<HH", self.out, vtable, 4 + 2 * top, len(self.out) - at)
        for place, kind, value in later:
            struct.pack_into("<I", self.out, place, self._object(kind, value) - place)
        return at

    def _object(self, kind: str, value: Any) -> int:
        if kind == "table":
            return self.table(value)
        if kind == "tables":
            self._align(4)
            at = len(self.out)
            self.out += struct.pack("<I", len(value)) + bytes(4 * len(value))
            for k, v in enumerate(value):
                place = at + 4 + 4 * k
                struct.pack_into("<I", self.out, place, self.table(v) - place)
            return at
        data, n, size = (value.encode() + b"\0", len(value.encode()), 1) if kind == "text" else (value, len(value), 1) if kind == "bytes" else (struct.pack(f"<{len(value)}{kind[7:]}", *value), len(value), struct.calcsize("<" + kind[7:]))
        self.out += b"\0" * (-(len(self.out) + 4) % max(4, size))
        at = len(self.out)
        self.out += struct.pack("<I", n) + data
        return at

    def finish(self, root: int) -> bytes:
        """With the size before it."""
        struct.pack_into("<I", self.out, 0, root)
        self._align(8)
        return struct.pack("<I", len(self.out)) + bytes(self.out)


# header


def _columns(tables: list[Table]) -> list[tuple[str, str, bool]]:
    return [(c.text(0), COLUMN_TYPES[c.number(1, "B")], bool(c.number(7, "?", True))) for c in tables]


@dataclass
class Header:
    name: str | None
    kind: str  # one of KINDS, or geometry
    dim: str
    columns: list[tuple[str, str, bool]]  # name, type, nullable
    count: int
    node_size: int
    crs: str | None
    envelope: tuple
    title: str | None
    description: str | None
    metadata: str | None
    end: int  # where the index begins

    @staticmethod
    def parse(data: bytes) -> Header:
        if data[:4] != MAGIC[:4]:
            raise GeoError("not FlatGeobuf")
        (size,) = struct.unpack_from("<I", data, 8)
        t = Table.root(data[12 : 12 + size])
        kind = t.number(2, "B")
        dim = "xy" + "z" * bool(t.number(3, "?", False)) + "m" * bool(t.number(4, "?", False))
        columns = _columns(t.tables(7))
        crs, c = None, t.table(10)
        if c is not None:
            crs = c.text(4) or (f"{c.text(0) or 'EPSG'}:{c.number(1, 'i')}" if c.number(1, "i") else None)
        return Header(t.text(0), KINDS[kind - 1] if 1 <= kind <= 7 else "geometry", dim, columns, t.number(8, "Q"), t.number(9, "H", 16), crs, t.vector(1, "d"), t.text(11), t.text(12), t.text(13), 12 + size)

    @property
    def index_size(self) -> int:
        return 40 * sum(_levels(self.count, self.node_size)) if self.node_size and self.count else 0

    def type(self) -> GeoType:
        form = None if self.crs is None else "authority_code" if ":" in self.crs and "[" not in self.crs else None
        return GeoType(self.kind if self.kind != "geometrycollection" else "geometry", self.dim if self.kind in KINDS else "xy", crs=self.crs, crs_form=form)

    def schema(self, geometry_name: str = "geometry", columns: list[str] | None = None, read_geometry: bool = True) -> T.StructType:
        names = [c for c in self.columns if columns is None or c[0] in columns]
        fields = [T.StructField(n, _SPARK[k], True) for n, k, _ in names]
        return T.StructType(fields + ([T.StructField(geometry_name, T.BinaryType())] if read_geometry else []))


def _levels(count: int, node_size: int) -> list[int]:
    """Numbers of nodes from the leaves to the root."""
    out = [count]
    while out[-1] > 1:
        out.append(-(-out[-1] // node_size))
    return out


def search(index: bytes, count: int, node_size: int, box: tuple[float, float, float, float]) -> list[int]:
    """Offsets of the features whose box in the packed R-tree meets box. The root comes first, the leaves last."""
    sizes = _levels(count, node_size)
    starts, at = [], sum(sizes)
    for n in sizes:
        at -= n
        starts.append(at)
    found, todo = [], [(len(sizes) - 1, 0)]
    while todo:
        level, node = todo.pop()
        x0, y0, x1, y1, offset = struct.unpack_from("<ddddQ", index, 40 * (starts[level] + node))
        if x1 < box[0] or y1 < box[1] or x0 > box[2] or y0 > box[3]:
            continue
        if level == 0:
            found.append(offset)
        else:
            todo += [(level - 1, k) for k in range(node * node_size, min((node + 1) * node_size, sizes[level - 1]))]
    return sorted(found)


def pack_index(boxes: list[tuple], offsets: list[int], node_size: int = 16) -> bytes:
    """The packed R-tree over boxes in the order of their features."""
    levels = [[(*b, o) for b, o in zip(boxes, offsets, strict=True)]]
    while len(levels[-1]) > 1:
        under = levels[-1]
        levels.append([(min(n[0] for n in g), min(n[1] for n in g), max(n[2] for n in g), max(n[3] for n in g), k) for k in range(0, len(under), node_size) for g in [under[k : k + node_size]]])
    sizes = [len(x) for x in levels]
    out, start = bytearray(), sum(sizes)
    places = []
    for n in sizes:
        start -= n
        places.append(start)
    for level in range(len(levels) - 1, -1, -1):
        for x0, y0, x1, y1, ref in levels[level]:
            # a leaf tells the feature's offset, others the number of their first child
            out += struct.pack("<ddddQ", x0, y0, x1, y1, ref if level == 0 else places[level - 1] + ref)
    return bytes(out)


def hilbert(x: int, y: int, bits: int = 16) -> int:
    """Distance along a Hilbert curve through a square of 2^bits a side."""
    d, s, side = 0, 1 << (bits - 1), (1 << bits) - 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = side - x, side - y
            x, y = y, x
        s >>= 1
    return d


# geometries


def _read_geometry(t: Table, kind: str, dim: str) -> G:
    if kind == "geometry":
        code = t.number(6, "B")
        if not 1 <= code <= 7:
            raise GeoError(f"FlatGeobuf geometry of type {code} is not supported")
        kind = KINDS[code - 1]
    if kind == "geometrycollection":
        return G(kind, dim, [_read_geometry(p, "geometry", dim) for p in t.tables(7)])
    if kind == "multipolygon":
        return G(kind, dim, [_read_geometry(p, "polygon", dim).value for p in t.tables(7)])
    xy, ends = t.vector(1, "d"), t.vector(0, "I")
    axes = [xy[::2], xy[1::2]] + ([t.vector(2, "d")] if "z" in dim else []) + ([t.vector(3, "d")] if "m" in dim else [])
    vs = list(zip(*axes, strict=True))
    if kind == "point":
        return G(kind, dim, None if not vs or all(map(math.isnan, vs[0])) else vs[0])
    if kind in ("linestring", "multipoint"):
        return G(kind, dim, vs)
    ends = ends or ((len(vs),) if vs else ())
    return G(kind, dim, [vs[a:b] for a, b in zip((0, *ends), ends)])


def _geometry_fields(g: G, mixed: bool) -> dict[int, tuple[str, Any]]:
    out: dict[int, tuple[str, Any]] = {6: ("B", KINDS.index(g.kind) + 1)} if mixed else {}
    if g.kind == "geometrycollection":
        return out | {7: ("tables", [_geometry_fields(x, True) for x in g.value])}
    if g.kind == "multipolygon":
        return out | {7: ("tables", [_geometry_fields(G("polygon", g.dim, x), True) for x in g.value])}
    vs = list(vertices(g)) if g.value is not None else [(math.nan,) * len(g.dim)]
    if g.kind in ("polygon", "multilinestring") and len(g.value) > 1:
        ends, n = [], 0
        for r in g.value:
            n += len(r)
            ends.append(n)
        out[0] = ("vector:I", ends)
    out[1] = ("vector:d", [c for p in vs for c in p[:2]])
    for k, a in ((2, "z"), (3, "m")):
        if a in g.dim:
            out[k] = ("vector:d", [p[g.dim.index(a)] for p in vs])
    return out


# properties


def _read_properties(data: bytes, columns: list[tuple[str, str, bool]]) -> dict[int, Any]:
    out, at = {}, 0
    while at + 2 <= len(data):
        (k,) = struct.unpack_from("<H", data, at)
        at += 2
        kind = columns[k][1]
        if kind in _FORMAT:
            (v,) = struct.unpack_from("<" + _FORMAT[kind], data, at)
            at += struct.calcsize("<" + _FORMAT[kind])
        else:
            (n,) = struct.unpack_from("<I", data, at)
            v = data[at + 4 : at + 4 + n]
            at += 4 + n
            if kind != "binary":
                v = v.decode()
            if kind == "datetime":
                v = _time(v)
        out[k] = v
    return out


def _time(text: str):
    import datetime

    t = datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t.astimezone(datetime.UTC).replace(tzinfo=None) if t.tzinfo else t


def _write_properties(row: dict, columns: list[tuple[str, str]]) -> bytes:
    out = bytearray()
    for k, (name, kind) in enumerate(columns):
        v = row[name]
        if v is None:
            continue
        out += struct.pack("<H", k)
        if kind in _FORMAT:
            out += struct.pack("<" + _FORMAT[kind], v)
        else:
            b = bytes(v) if kind == "binary" else (v.isoformat() if kind == "datetime" else v).encode()
            out += struct.pack("<I", len(b)) + b
    return bytes(out)


# the data source


#: Features of a partition; nodes of the index that the driver looks at; bytes that a scan for columns reads at a time.
RUN, NODES, SCAN_BYTES = 50_000, 4096, 1 << 20
_LEAF = np.dtype([("x0", "<f8"), ("y0", "<f8"), ("x1", "<f8"), ("y1", "<f8"), ("offset", "<u8")])


@dataclass
class _Run(InputPartition):
    """Spans of features by the index, each from a first up to but without a last; all of the file's if there are none."""

    path: str
    spans: list


def runs(spark: SparkSession, path: str, header: Header, box: list[float] | None) -> list[tuple[str, list]]:
    """Partitions: the path and spans of RUN features in all, those aside that an upper level of the index shows to miss the box."""
    if not header.index_size:
        return [(path, [])]
    spans = [(0, header.count)]
    if box is not None:
        sizes = _levels(header.count, header.node_size)
        level = next(k for k, n in enumerate(sizes) if n <= NODES)
        nodes = np.frombuffer(read_range(spark, path, header.end + _LEAF.itemsize * sum(sizes[level + 1 :]), _LEAF.itemsize * sizes[level]), _LEAF)
        under = header.node_size**level
        spans = []
        for k in np.flatnonzero(_meet(nodes, box)).tolist():
            if spans and spans[-1][1] == k * under:
                spans[-1] = (spans[-1][0], min((k + 1) * under, header.count))
            else:
                spans.append((k * under, min((k + 1) * under, header.count)))
    out, n = [], RUN
    for a, z in [(a, min(a + RUN, z)) for first, z in spans for a in range(first, z, RUN)]:
        if n + z - a > RUN:
            out.append((path, []))
            n = 0
        out[-1][1].append((a, z))
        n += z - a
    return out


def _meet(nodes: np.ndarray, box: list[float]) -> np.ndarray:
    return (nodes["x1"] >= box[0]) & (nodes["y1"] >= box[1]) & (nodes["x0"] <= box[2]) & (nodes["y0"] <= box[3])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.wanted = options, schema

    def partitions(self) -> list[InputPartition]:
        return [_Run(*r) for r in json.loads(self.options["runs"])] or [_Run("", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = _arrow_fs(partition.path)
        box = json.loads(self.options.get("bbox", "null"))
        batch_size = int(self.options.get("batch_size", 65536))
        schema = to_arrow_schema(self.wanted)
        name = self.options["geometry_name"]
        with fs.open_input_file(path) as f:
            head = f.read(12)
            if head[:4] != MAGIC[:4]:
                raise GeoError(f"{path} is not FlatGeobuf")
            header = Header.parse(head + f.read(struct.unpack_from("<I", head, 8)[0]))
            first = header.end + header.index_size
            offsets, left = None, math.inf
            if partition.spans:
                parts = []
                for a, z in partition.spans:
                    f.seek(first - _LEAF.itemsize * (header.count - a))
                    parts.append(np.frombuffer(f.read(_LEAF.itemsize * (z - a)), _LEAF))
                leaves = np.concatenate(parts)
                if box is not None:
                    offsets = np.sort(leaves["offset"][_meet(leaves, box)]).tolist()
                else:  # one span, whose features follow each other in the order of the leaves
                    left = len(leaves)
                    first += int(leaves["offset"].min())
            f.seek(first)
            rows: list[dict] = []
            want = [n for n in schema.names if n != name]
            own, known = not header.columns, set(json.loads(self.options.get("scanned", "[]")))
            todo = iter(offsets) if offsets is not None else None
            while left > 0:
                left -= 1
                if todo is not None:
                    nxt = next(todo, None)
                    if nxt is None:
                        break
                    f.seek(first + nxt)
                size = f.read(4)
                if len(size) < 4:
                    break
                t = Table.root(f.read(struct.unpack("<I", size)[0]))
                shape = t.table(0)
                g = _read_geometry(shape, header.kind, header.dim) if shape is not None and (name in schema.names or box is not None) else None
                if box is not None and offsets is None and not _meets(g, box):
                    continue
                columns = _columns(t.tables(2)) if own else header.columns
                if own and (new := {c[0] for c in columns} - known):
                    raise GeoError(f"columns beyond those of the first records: {', '.join(sorted(new))}; raise max_scan_records")
                p = {columns[k][0]: v for k, v in _read_properties(t.raw(1), columns).items()}
                row = {n: p.get(n) for n in want}
                if name in schema.names:
                    row[name] = None if g is None else to_wkb(g)
                rows.append(row)
                if len(rows) >= batch_size:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _meets(g: G | None, box: list[float]) -> bool:
    b = None if g is None else kernel._box(g)
    return b is not None and b[2] >= box[0] and b[3] >= box[1] and b[0] <= box[2] and b[1] <= box[3]


class FlatGeobufSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_flatgeobuf"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def read_header(spark: SparkSession, path: str) -> Header:
    from tessera.sources.paths import read_bytes

    size = struct.unpack_from("<I", read_bytes(spark, path, 12), 8)[0]
    return Header.parse(read_bytes(spark, path, 12 + size))


def scan_columns(spark: SparkSession, path: str, header: Header, max_scan_records: int | None = 1000) -> list[tuple[str, str, bool]]:
    """The columns that the first records name for themselves, in order; all records if max_scan_records is None. A column of two types raises."""
    found: dict[str, tuple[str, str, bool]] = {}
    at, data, n = header.end + header.index_size, b"", 0
    while max_scan_records is None or n < max_scan_records:
        size = struct.unpack_from("<I", data)[0] if len(data) >= 4 else None
        if size is None or len(data) < 4 + size:
            more = read_range(spark, path, at, max(SCAN_BYTES, 0 if size is None else size))
            if not more:
                break
            data, at = data + more, at + len(more)
            continue
        for c in _columns(Table.root(data[4 : 4 + size]).tables(2)):
            if found.setdefault(c[0], c)[1] != c[1]:
                raise GeoError(f"records differ in the type of {c[0]}")
        data, n = data[4 + size :], n + 1
    return list(found.values())


def read_flatgeobuf(
    spark: SparkSession, paths: str | list[str], bbox: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, read_geometry: bool = True, batch_size: int = 65536, geometry_name: str = "geometry", max_scan_records: int | None = 1000
) -> DataFrame:
    """The features of files whose headers agree. bbox searches each file's index, or looks at each feature where there is none.

    Where headers name no columns, the first max_scan_records records of each
    file do (None: all of them).
    """
    files = list_files(spark, paths, ".fgb")
    if not files:
        raise GeoError("no FlatGeobuf files")
    with ThreadPoolExecutor(min(THREADS, len(files))) as pool:
        headers = list(pool.map(lambda f: read_header(spark, f), files))
    scanned: list[str] = []
    if not any(h.columns for h in headers):
        found: dict[str, tuple[str, str, bool]] = {}
        for f, h in zip(files, headers, strict=True):
            for c in scan_columns(spark, f, h, max_scan_records):
                if found.setdefault(c[0], c)[1] != c[1]:
                    raise GeoError(f"files differ in the type of {c[0]}")
        headers, scanned = [replace(h, columns=list(found.values())) for h in headers], list(found)
    first = headers[0]
    for h in headers[1:]:
        if (h.columns, h.kind, h.dim, h.crs) != (first.columns, first.kind, first.dim, first.crs):
            raise GeoError("files differ in columns, geometry type, dimension or CRS")
    missing = set(columns or ()) - {c[0] for c in first.columns}
    if missing:
        raise GeoError(f"no such columns: {', '.join(sorted(missing))}")
    spark.dataSource.register(FlatGeobufSource)
    schema = first.schema(geometry_name, columns, read_geometry)
    box = None if bbox is None else [min(bbox[0], bbox[2]), min(bbox[1], bbox[3]), max(bbox[0], bbox[2]), max(bbox[1], bbox[3])]
    parts = [r for f, h in zip(files, headers, strict=True) for r in runs(spark, f, h, box)]
    options = {"runs": json.dumps(parts), "schema": schema.json(), "batch_size": str(batch_size), "geometry_name": geometry_name, "scanned": json.dumps(scanned)}
    if box is not None:
        options["bbox"] = json.dumps(box)
    df = spark.read.format("tessera_flatgeobuf").options(**options).load()
    if read_geometry:
        t = first.type()
        df = df.withColumn(geometry_name, (kernel.from_wkb(F.col(f"`{geometry_name}`"), t) if t.native else Geo(F.col(f"`{geometry_name}`"), t)).alias(geometry_name))
    return df


_BACK = {T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "bool", T.StringType: "string", T.BinaryType: "binary", T.TimestampNTZType: "datetime", T.TimestampType: "datetime", T.DateType: "datetime"}


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        from pyspark import TaskContext

        o = json.loads(self.options["plan"])
        name, columns, mixed = o["geometry"], [tuple(c) for c in o["columns"]], o["kind"] == "geometry"
        features: list[tuple[tuple, bytes]] = []
        for batch in iterator:
            for row in batch.to_pylist():
                g = from_wkb(row[name]) if row[name] is not None else None
                fields: dict[int, tuple[str, Any]] = {}
                if g is not None:
                    if not mixed and o["multi"] and not g.kind.startswith("multi") and g.kind != "geometrycollection":
                        g = G("multi" + g.kind, g.dim, [] if g.value is None else [g.value])
                    fields[0] = ("table", _geometry_fields(g, mixed))
                fields[1] = ("bytes", _write_properties(row, columns))
                b = Builder()
                box = (kernel._box(g) if g is not None else None) or (math.inf, math.inf, -math.inf, -math.inf)
                features.append((box, b.finish(b.table(fields))))
        if not features:
            return _Done(None)
        real = [b for b, _ in features if b[0] <= b[2]]
        whole = (min(b[0] for b in real), min(b[1] for b in real), max(b[2] for b in real), max(b[3] for b in real)) if real else ()
        if o["index"]:

            def place(b: tuple) -> int:
                if not whole or b[0] > b[2]:
                    return 0
                w, h = whole[2] - whole[0], whole[3] - whole[1]
                return hilbert(int(65535 * ((b[0] + b[2]) / 2 - whole[0]) / w) if w else 0, int(65535 * ((b[1] + b[3]) / 2 - whole[1]) / h) if h else 0)

            features.sort(key=lambda f: place(f[0]))
        h: dict[int, tuple[str, Any]] = {0: ("text", o["name"]), 1: ("vector:d", whole), 2: ("B", 0 if mixed else KINDS.index(o["kind"]) + 1), 3: ("?", "z" in o["dim"]), 4: ("?", "m" in o["dim"])}
        h[7] = ("tables", [{0: ("text", n), 1: ("B", COLUMN_TYPES.index(k))} for n, k in columns])
        h[8] = ("Q", len(features))
        h[9] = ("H", 16 if o["index"] else 0)
        if o["crs"]:
            org, _, code = o["crs"].partition(":")
            h[10] = ("table", {0: ("text", org), 1: ("i", int(code))} if code.isdigit() else {4: ("text", o["crs"])})
        for k, key in ((11, "title"), (12, "description"), (13, "metadata")):
            if o[key] is not None:
                h[k] = ("text", o[key])
        b = Builder()
        fs, folder = _arrow_fs(self.options["path"])
        work = f"{folder}/_temporary-{self.options['job']}"
        fs.create_dir(work, recursive=True)
        file = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.fgb"
        with fs.open_output_stream(f"{work}/{file}") as f:
            f.write(MAGIC + b.finish(b.table(h)))
            if o["index"]:
                offsets, at = [], 0
                for _, data in features:
                    offsets.append(at)
                    at += len(data)
                f.write(pack_index([x for x, _ in features], offsets))
            for _, data in features:
                f.write(data)
        return _Done(file)

    def commit(self, messages: list) -> None:
        fs, folder = _arrow_fs(self.options["path"])
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{folder}/_temporary-{self.options['job']}/{m.name}", f"{folder}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs as afs

        fs, folder = _arrow_fs(self.options["path"])
        work = f"{folder}/_temporary-{self.options['job']}"
        if fs.get_file_info(work).type != afs.FileType.NotFound:
            fs.delete_dir(work)


def write_flatgeobuf(df: DataFrame, path: str, name: str = "layer", index: bool = True, promote_to_multi: bool = False, title: str | None = None, description: str | None = None, metadata: str | None = None, mode: str = "error") -> None:
    """One file for each partition of df, which holds its features in memory for the index; just one geometry column. Structs, arrays and maps are written as JSON."""
    import uuid

    names = geometry_columns(df)
    if len(names) != 1:
        raise GeoError(f"one geometry column is needed, not {len(names)}")
    spark, g = df.sparkSession, geo(df, names[0])
    if exists(spark, path):
        if mode == "error":
            raise GeoError(f"{path} exists")
        if mode == "overwrite":
            delete(spark, path)
    columns = []
    out = df
    for f in df.schema.fields:
        if f.name == names[0]:
            continue
        kind = _BACK.get(type(f.dataType))
        if kind is None and isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            kind, out = "json", out.withColumn(f.name, F.to_json(F.col(f"`{f.name}`")))
        if kind is None:
            raise GeoError(f"column {f.name} of type {f.dataType.simpleString()} cannot be written")
        if kind == "datetime":
            out = out.withColumn(f.name, F.col(f"`{f.name}`").cast("timestamp_ntz"))
        columns.append((f.name, kind))
    out = out.withColumn(names[0], kernel.to_wkb(g).column)
    kind = g.type.kind if g.type.native else "polygon" if g.type.kind == "box" else "geometry"
    if promote_to_multi and kind in ("point", "linestring", "polygon"):
        kind = "multi" + kind
    plan = {"geometry": names[0], "columns": columns, "kind": kind, "dim": g.type.dim, "multi": promote_to_multi, "index": index, "name": name, "crs": g.type.crs, "title": title, "description": description, "metadata": metadata}
    spark.dataSource.register(FlatGeobufSource)
    out.write.format("tessera_flatgeobuf").mode("append").options(path=path, plan=json.dumps(plan), job=uuid.uuid4().hex[:8], schema=out.schema.json(), runs="[]").save()
