"""GeoParquet: Parquet whose footer tells the geometry columns.

Reading: footers are read by many threads where the driver runs, checked
against each other, and files whose box misses the query's are left out; then
Spark reads what is left, and a box filter on the covering column's leaves
reaches the scan. Writing: a Python data source writes one file a task, so that
each file's footer tells its box and kinds; files of one table may hold
different kinds, which are joined when it is read.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import kernel, native
from tessera.sources.paths import arrow_uri, delete, exists, list_files
from tessera.types import Geo, GeoError, GeoType, free_name, geo, geometry_columns

VERSION = "1.1.0"
_NAMES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


@dataclass
class GeoMeta:
    """The footer's `geo` entry."""

    version: str
    primary_column: str
    columns: dict[str, dict]
    write: str | None = None  # the same in all files of one write of this library

    @staticmethod
    def parse(text: str) -> GeoMeta:
        x = json.loads(text)
        for k in ("version", "primary_column", "columns"):
            if k not in x:
                raise GeoError(f"geo metadata has no {k}")
        return GeoMeta(x["version"], x["primary_column"], x["columns"], x.get("write"))

    def json(self) -> str:
        more = {"write": self.write} if self.write else {}
        return json.dumps({"version": self.version, "primary_column": self.primary_column, "columns": self.columns} | more)

    def bbox(self, column: str | None = None) -> tuple[float, ...] | None:
        """x and y of the column's box."""
        b = self.columns[column or self.primary_column].get("bbox")
        if b is None:
            return None
        n = len(b) // 2
        return (b[0], b[1], b[n], b[n + 1])

    def covering(self, column: str | None = None) -> dict[str, list[str]] | None:
        """Paths of the leaves xmin, ymin, xmax and ymax."""
        column = column or self.primary_column
        meta = self.columns[column]
        if "covering" in meta:
            return meta["covering"]["bbox"]
        if meta["encoding"] == "point":
            return {"xmin": [column, "x"], "ymin": [column, "y"], "xmax": [column, "x"], "ymax": [column, "y"]}
        return None

    def type_of(self, column: str, dtype: T.DataType | None = None) -> GeoType:
        meta = self.columns[column]
        crs = meta.get("crs", "OGC:CRS84")
        ref = {"crs": json.dumps(crs, sort_keys=True) if isinstance(crs, dict) else crs, "crs_form": "projjson" if isinstance(crs, dict) else None if crs is None else "authority_code"}
        edges = meta.get("edges")
        ref["edges"] = None if edges in (None, "planar") else edges
        kinds = meta.get("geometry_types") or []
        dims = {"xyz" if k.endswith(" Z") else "xym" if k.endswith(" M") else "xyzm" if k.endswith(" ZM") else "xy" for k in kinds}
        if meta["encoding"] != "WKB":
            dim = "xy"
            while isinstance(dtype, T.ArrayType):
                dtype = dtype.elementType
            if isinstance(dtype, T.StructType):
                dim = "".join(f.name for f in dtype.fields)
            return GeoType(meta["encoding"], dim, **ref)
        names = {k.split(" ")[0].lower() for k in kinds}
        if len(dims) == 1:
            if len(names) == 1:
                return GeoType(names.pop(), dims.pop(), **ref)
            base = {n.removeprefix("multi") for n in names}
            if len(base) == 1 and base <= {"point", "linestring", "polygon"}:
                return GeoType("multi" + base.pop(), dims.pop(), **ref)
        return GeoType("geometry", **ref)


def merge(metas: list[GeoMeta]) -> GeoMeta:
    """One entry for several files: version, primary column, encodings, kinds, length of boxes and CRS must agree; boxes are joined.

    The files of one write are parts of one table: each tells the kinds of its
    own rows, and these are joined; files without a geometry say nothing.
    """
    first = metas[0]
    together = first.write is not None and all(m.write == first.write for m in metas)
    columns = {c: dict(m) for c, m in first.columns.items()}
    for other in metas[1:]:
        if (other.version, other.primary_column, set(other.columns)) != (first.version, first.primary_column, set(columns)):
            raise GeoError("files differ in version, primary column or geometry columns")
        for c, m in other.columns.items():
            mine = columns[c]
            for k, usual in (("encoding", None), ("crs", "OGC:CRS84")):
                if m.get(k, usual) != mine.get(k, usual):
                    raise GeoError(f"files differ in {k} of {c}")
            kinds = set(m.get("geometry_types") or []), set(mine.get("geometry_types") or [])
            if together:
                mine["geometry_types"] = sorted(kinds[0] | kinds[1])
            elif kinds[0] != kinds[1]:
                raise GeoError(f"files differ in geometry_types of {c}")
            a, b = mine.get("bbox"), m.get("bbox")
            if a and b and len(a) != len(b):
                raise GeoError(f"files differ in length of bbox of {c}")
            if a and b:
                n = len(a) // 2
                mine["bbox"] = [min(x, y) for x, y in zip(a[:n], b[:n])] + [max(x, y) for x, y in zip(a[n:], b[n:])]
            elif together and (a or b):
                mine["bbox"] = a or b
            else:
                mine.pop("bbox", None)
    return replace(first, columns=columns)


#: Footers that are read at a time.
THREADS = 32


def _footers(spark: SparkSession, files: list[str], leaves: bool = False) -> list[dict]:
    """Rows of each row group, the geo entry and, if asked for, each row group's bounds of leaves, from the files' ends. The files are read by Hadoop's file systems, some at a time."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def one(f: str) -> dict:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf))
        try:
            footer = reader.getFooter()
            geo_text = footer.getFileMetaData().getKeyValueMetaData().get("geo")
            groups = []
            for block in footer.getBlocks():
                bounds = {}
                for c in block.getColumns() if leaves else ():
                    s = c.getStatistics()
                    if s is not None and s.hasNonNullValue():
                        bounds[c.getPath().toDotString()] = (s.genericGetMin(), s.genericGetMax())
                groups.append({"rows": block.getRowCount(), "leaves": bounds})
            return {"path": f, "geo": geo_text, "groups": groups}
        finally:
            reader.close()

    with ThreadPoolExecutor(min(THREADS, len(files) or 1)) as pool:
        return list(pool.map(one, files))


@dataclass
class GeoParquetDataset:
    """GeoParquet files that agree. Footers are read once, where the driver runs."""

    spark: SparkSession
    files: list[str]
    footers: list[dict]
    metas: list[GeoMeta]
    meta: GeoMeta = field(init=False)

    def __post_init__(self) -> None:
        self.meta = merge(self.metas)

    @staticmethod
    def open(spark: SparkSession, paths: str | list[str]) -> GeoParquetDataset:
        files = list_files(spark, paths, ".parquet")
        if not files:
            raise GeoError("no Parquet files")
        footers = _footers(spark, files)
        if any(f["geo"] is None for f in footers):
            raise GeoError("not GeoParquet: a file has no geo metadata")
        return GeoParquetDataset(spark, files, footers, [GeoMeta.parse(f["geo"]) for f in footers])

    @property
    def num_rows(self) -> int:
        return sum(g["rows"] for f in self.footers for g in f["groups"])

    @property
    def num_row_groups(self) -> int:
        return sum(len(f["groups"]) for f in self.footers)

    def crs(self, column: str | None = None):
        return self.meta.columns[column or self.meta.primary_column].get("crs", "OGC:CRS84")

    def bbox(self, column: str | None = None) -> tuple[float, ...] | None:
        return self.meta.bbox(column)

    def fragments(self) -> list[GeoParquetDataset]:
        return [GeoParquetDataset(self.spark, [f], [r], [m]) for f, r, m in zip(self.files, self.footers, self.metas, strict=True)]

    def row_group_bounds(self, column: str | None = None) -> list[tuple[float, float, float, float] | None]:
        """Boxes of all row groups, from the statistics of the covering's leaves; none where there are none."""
        out = []
        for footer, meta in zip(_footers(self.spark, self.files, True), self.metas, strict=True):
            cover = meta.covering(column)
            for g in footer["groups"]:
                leaf = {k: g["leaves"].get(".".join(p)) for k, p in (cover or {}).items()}
                out.append((float(leaf["xmin"][0]), float(leaf["ymin"][0]), float(leaf["xmax"][1]), float(leaf["ymax"][1])) if leaf and all(leaf.values()) else None)
        return out

    def read(self, bbox: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, parse_to_native: bool = True, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """The rows, those whose box meets bbox if there is one.

        Geometry columns come in native form where their kinds allow, else as
        WKB. Columns without a covering are filtered by their geometries. limit
        and offset count rows in the order of files and of rows in them: without
        a box the footers tell which files hold these rows, and no other is
        read; with one the rows are put in that order.
        """
        files = self.files
        if bbox is None:
            df = self._typed(self._slice(offset or 0, limit))
        else:
            x0, y0, x1, y1 = min(bbox[0], bbox[2]), min(bbox[1], bbox[3]), max(bbox[0], bbox[2]), max(bbox[1], bbox[3])
            near = [f for f, m in zip(files, self.metas, strict=True) if (b := m.bbox()) is None or (b[2] >= x0 and b[3] >= y0 and b[0] <= x1 and b[1] <= y1)]
            df = self.spark.read.parquet(*(near or files[:1]))
            place = free_name(df)
            if offset or limit is not None:
                df = df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(place))
            df = self._typed(df)
            cover = self.meta.covering()
            g = geo(df, self.meta.primary_column)
            if cover:
                leaf = {k: F.col(".".join(f"`{x}`" for x in p)) for k, p in cover.items()}
                df = df.filter((leaf["xmax"] >= x0) & (leaf["ymax"] >= y0) & (leaf["xmin"] <= x1) & (leaf["ymin"] <= y1))
            else:
                b = native.bounding_rect(g).column if g.type.native else bounds_of(g)
                df = df.filter((b["xmax"] >= x0) & (b["ymax"] >= y0) & (b["xmin"] <= x1) & (b["ymin"] <= y1))
            if offset or limit is not None:
                df = df.orderBy(place).offset(offset or 0)
                df = (df if limit is None else df.limit(limit)).drop(place)
        if columns is not None:
            df = df.select(*columns)
        return self._parsed(df) if parse_to_native else df

    def read_row_groups(self, groups: list[int], columns: list[str] | None = None, parse_to_native: bool = True) -> DataFrame:
        """The rows of some row groups, counted over all files in order; each is read by a task of its own."""
        places = [(f["path"], k) for f in self.footers for k in range(len(f["groups"]))]
        schema = self.spark.read.parquet(*self.files).schema
        if columns is not None:
            schema = T.StructType([schema[c] for c in columns])
        target = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    fs, at = _arrow_fs(path)
                    with fs.open_input_file(at) as f:
                        table = pq.ParquetFile(f).read_row_group(k, target.names)
                        yield from table.select(target.names).cast(target).to_batches()

        chosen = self.spark.createDataFrame([places[k] for k in groups], "path string, k int")
        df = self._typed(chosen.repartition(max(1, len(groups)), "path", "k").mapInArrow(run, schema))
        return self._parsed(df) if parse_to_native else df

    def _slice(self, offset: int, limit: int | None) -> DataFrame:
        """The rows from one place on, by the files that hold them."""
        read = self.spark.read.parquet
        if not offset and limit is None:
            return read(*self.files)
        parts, whole, at = [], [], 0
        end = math.inf if limit is None else offset + limit
        for f in self.footers:
            n = sum(g["rows"] for g in f["groups"])
            a, z = max(offset - at, 0), min(end - at, n)
            at += n
            if (a, z) == (0, n):
                whole.append(f["path"])
            elif a < z:
                row = F.col("_metadata.row_index")
                parts.append(read(f["path"]).filter((row >= a) & (row < z)))
        out = [read(*whole)] if whole else []
        return reduce(DataFrame.unionByName, out + parts) if out or parts else read(self.files[0]).limit(0)

    def _typed(self, df: DataFrame) -> DataFrame:
        """Geometry columns as they are stored, with their types."""
        for c in self.meta.columns:
            if c in df.columns:
                t = self.meta.type_of(c, df.schema[c].dataType)
                stored = t if self.meta.columns[c]["encoding"] != "WKB" else replace(t, kind="wkb", dim="xy")
                df = df.withColumn(c, Geo(F.col(f"`{c}`"), stored).alias(c))
        return df

    def _parsed(self, df: DataFrame) -> DataFrame:
        """WKB in native form where the kinds allow."""
        for c in self.meta.columns:
            t = self.meta.type_of(c)
            if c in df.columns and self.meta.columns[c]["encoding"] == "WKB" and t.native:
                df = df.withColumn(c, kernel.from_wkb(F.col(f"`{c}`"), t).alias(c))
            elif c in df.columns and self.meta.columns[c]["encoding"] == "WKB":
                df = df.withColumn(c, Geo(F.col(f"`{c}`"), replace(t, kind="geometry", dim="xy")).alias(c))
        return df


def read_geoparquet(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return GeoParquetDataset.open(spark, paths).read(**options)


_BOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("xmin", "ymin", "xmax", "ymax")])


def bounds_of(g: Geo):
    """The box of WKB geometries; null for empty ones."""

    def box(x) -> dict | None:
        b = kernel._box(x)
        return None if b is None else dict(zip(("xmin", "ymin", "xmax", "ymax"), b, strict=True))

    return kernel._call(box, _BOX, [g])


# writing


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        o = self.options
        meta, hidden = json.loads(o["geo"]), json.loads(o["hidden"])
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        fs, folder = _arrow_fs(o["path"])
        work = f"{folder}/_temporary-{o['job']}"
        fs.create_dir(work, recursive=True)
        seen = {c: {"ids": set(), "box": [math.inf, math.inf, -math.inf, -math.inf]} for c in meta["columns"]}
        writer, sink, rows = None, None, 0
        for batch in iterator:
            rows += batch.num_rows
            table = pa.Table.from_batches([batch])
            for c, names in hidden.items():
                s = seen[c]
                s["ids"] |= {x for x in table.column(names["id"]).to_pylist() if x is not None}
                for b in table.column(names["box"]).to_pylist():
                    if b is not None:
                        v = s["box"]
                        s["box"] = [min(v[0], b["xmin"]), min(v[1], b["ymin"]), max(v[2], b["xmax"]), max(v[3], b["ymax"])]
            table = table.drop_columns([n for names in hidden.values() for n in names.values()])
            if writer is None:
                sink = fs.open_output_stream(f"{work}/{name}")
                writer = pq.ParquetWriter(sink, table.schema, compression=o["compression"], version="2.6")
            writer.write_table(table, row_group_size=int(o["row_group_size"]))
        if writer is None:
            # only the first task of all may have to write a file without rows: a table needs one
            if TaskContext.get().partitionId():
                return _Done(None)
            sink = fs.open_output_stream(f"{work}/{name}")
            writer = pq.ParquetWriter(sink, pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(o["schema"]))), compression=o["compression"], version="2.6")
        for c, s in seen.items():
            m = meta["columns"][c]
            m["geometry_types"] = sorted({_NAMES[i % 10 - 1] + ("", " Z", " M", " ZM")[i // 10] for i in s["ids"]})
            if s["box"][0] <= s["box"][2]:
                m["bbox"] = s["box"]
        writer.add_key_value_metadata({"geo": json.dumps(meta)})
        writer.close()
        sink.close()
        return _Done(name, rows)

    def commit(self, messages: list) -> None:
        fs, folder = _arrow_fs(self.options["path"])
        work = f"{folder}/_temporary-{self.options['job']}"
        done = [m for m in messages if m is not None and m.name]
        # files without rows stay only if there is no other
        for m in [m for m in done if m.rows] or done[:1]:
            fs.move(f"{work}/{m.name}", f"{folder}/{m.name}")
        self.abort(messages)
        with fs.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        from pyarrow import fs as afs

        fs, folder = _arrow_fs(self.options["path"])
        work = f"{folder}/_temporary-{self.options['job']}"
        if fs.get_file_info(work).type != afs.FileType.NotFound:
            fs.delete_dir(work)


@dataclass
class _Done(WriterCommitMessage):
    name: str | None
    rows: int = 0


def _arrow_fs(path: str):
    from pyarrow import fs as afs

    return afs.FileSystem.from_uri(arrow_uri(path))


class GeoParquetSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_geoparquet"

    def schema(self) -> str:
        return "g binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write_geoparquet(df: DataFrame, path: str, encoding: str | dict[str, str] = "WKB", generate_covering: bool = False, primary: str | None = None, compression: str = "zstd", row_group_size: int = 100_000, mode: str = "error") -> None:
    """One file for each partition of df that has rows under path, a folder that all executors share; a table without rows is one file without rows.

    encoding: WKB, or native for columns of one of the six kinds. A covering
    column of boxes is called bbox for a column named geometry or geography,
    else <column>_bbox; null where there is no box. The primary column is
    primary, else geometry or geography, else the first by name.
    """
    spark = df.sparkSession
    names = geometry_columns(df)
    if not names:
        raise GeoError("no geometry column")
    if primary is not None and primary not in names:
        raise GeoError(f"{primary} is no geometry column")
    usual = [c for c in names if c in ("geometry", "geography")]
    primary = primary or (usual[0] if usual else sorted(names)[0])
    if exists(spark, path):
        if mode == "error":
            raise GeoError(f"{path} exists")
        if mode == "overwrite":
            delete(spark, path)
    job = uuid.uuid4().hex
    meta: dict = {"version": VERSION, "primary_column": primary, "columns": {}, "write": job}
    hidden: dict = {}
    out, own = df, free_name(df)
    for c in names:
        g = geo(df, c)
        want = encoding if isinstance(encoding, str) else encoding.get(c, "WKB")
        if want == "native" and not g.type.native:
            raise GeoError(f"column {c} ({g.type.kind}) has no native encoding")
        box = native.bounding_rect(g).column if g.type.native or g.type.kind == "box" else bounds_of(kernel.to_wkb(g) if g.type.kind == "wkt" else g)
        as_wkb = g if g.type.kind in ("wkb", "geometry") else kernel.to_wkb(g)
        entry: dict = {"encoding": "WKB" if want != "native" else g.type.kind, "geometry_types": []}
        if g.type.crs is None:
            entry["crs"] = None
        elif g.type.crs_form == "projjson":
            entry["crs"] = json.loads(g.type.crs)
        elif g.type.crs != "OGC:CRS84":
            entry["crs"] = g.type.crs
        if g.type.edges:
            entry["edges"] = g.type.edges
        hidden[c] = {"id": f"{own}_id_{c}", "box": f"{own}_box_{c}"}
        out = out.withColumn(hidden[c]["box"], box).withColumn(hidden[c]["id"], native.type_id(g if g.type.type_id is not None else as_wkb).cast("int"))
        if generate_covering:
            cover = "bbox" if c in ("geometry", "geography") else f"{c}_bbox"
            entry["covering"] = {"bbox": {k: [cover, k] for k in ("xmin", "ymin", "xmax", "ymax")}}
            out = out.withColumn(cover, F.col(f"`{hidden[c]['box']}`"))
        if want != "native":
            out = out.withColumn(c, as_wkb.column)
        meta["columns"][c] = entry
    # of a table without rows, a file tells the schema
    stored = to_arrow_schema(out.drop(*[n for names in hidden.values() for n in names.values()]).schema)
    spark.dataSource.register(GeoParquetSink)
    out.write.format("tessera_geoparquet").mode("append").options(path=path, geo=json.dumps(meta), hidden=json.dumps(hidden), compression=compression, row_group_size=str(row_group_size), schema=stored.serialize().to_pybytes().hex(), job=job[:8]).save()


