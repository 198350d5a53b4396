"""Geometry columns: what kind of geometry a column holds, how it is stored, and what is known about its coordinates.

A native column nests arrays of vertex structs; mixed columns and collections
are WKB. What Spark's type does not tell is kept in the field's metadata under
`geo`, which survives Parquet.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in order of their codes 1 to 7.
KINDS = ("point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection")
#: Dimensions in order: their type ids start at 0, 10, 20 and 30.
DIMS = ("xy", "xyz", "xym", "xyzm")
#: How many arrays the vertices of a native column are nested in.
DEPTH = {"point": 0, "linestring": 1, "multipoint": 1, "polygon": 2, "multilinestring": 2, "multipolygon": 3}
#: Ways to interpolate between vertices; none: planar.
EDGES = ("andoyer", "karney", "spherical", "thomas", "vincenty")
CRS_FORMS = ("projjson", "wkt2:2019", "authority_code", "srid")
#: The single-part kind of each multi-part kind.
SINGLE = {"multipoint": "point", "multilinestring": "linestring", "multipolygon": "polygon"}
MULTI = {v: k for k, v in SINGLE.items()}


class GeoError(ValueError):
    """A geometry type does not allow what is asked for."""


@dataclass(frozen=True)
class GeoType:
    """kind: one of KINDS, or box, geometry (mixed, WKB), wkb or wkt."""

    kind: str
    dim: str = "xy"
    crs: str | None = None
    crs_form: str | None = None
    edges: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in (*KINDS, "box", "geometry", "wkb", "wkt"):
            raise GeoError(f"unknown geometry kind {self.kind!r}")
        if self.dim not in DIMS:
            raise GeoError(f"unknown dimension {self.dim!r}")
        if self.edges is not None and self.edges not in EDGES:
            raise GeoError(f"unknown edges {self.edges!r}")
        if self.crs_form is not None and self.crs_form not in CRS_FORMS:
            raise GeoError(f"unknown CRS form {self.crs_form!r}")

    @property
    def native(self) -> bool:
        return self.kind in DEPTH

    @property
    def type_id(self) -> int | None:
        """Code of the dimension and kind; a box counts as a polygon; none for mixed and serialized columns."""
        if self.kind in KINDS or self.kind == "box":
            return 10 * DIMS.index(self.dim) + (KINDS.index(self.kind) + 1 if self.kind in KINDS else 3)
        return None

    @property
    def storage(self) -> T.DataType:
        if self.kind == "wkt":
            return T.StringType()
        if self.kind == "box":
            return T.StructType([T.StructField(f"{a}{e}", T.DoubleType()) for e in ("min", "max") for a in self.dim])
        if not self.native:
            return T.BinaryType()
        out: T.DataType = T.StructType([T.StructField(a, T.DoubleType()) for a in self.dim])
        for _ in range(DEPTH[self.kind]):
            out = T.ArrayType(out)
        return out

    def metadata(self) -> dict:
        return {"geo": json.dumps({k: v for k, v in self.__dict__.items() if v is not None}, sort_keys=True)}

    def field(self, name: str, nullable: bool = True) -> T.StructField:
        return T.StructField(name, self.storage, nullable, self.metadata())

    def with_crs(self, crs: str | None, form: str | None = None) -> GeoType:
        """Another CRS for the same numbers: nothing is projected."""
        return replace(self, crs=crs, crs_form=form)

    def same_reference(self, other: GeoType) -> bool:
        return (self.crs, self.edges) == (other.crs, other.edges)


# shorthands


def point(dim: str = "xy", **k) -> GeoType:
    return GeoType("point", dim, **k)


def linestring(dim: str = "xy", **k) -> GeoType:
    return GeoType("linestring", dim, **k)


def polygon(dim: str = "xy", **k) -> GeoType:
    return GeoType("polygon", dim, **k)


def multipoint(dim: str = "xy", **k) -> GeoType:
    return GeoType("multipoint", dim, **k)


def multilinestring(dim: str = "xy", **k) -> GeoType:
    return GeoType("multilinestring", dim, **k)


def multipolygon(dim: str = "xy", **k) -> GeoType:
    return GeoType("multipolygon", dim, **k)


def geometrycollection(dim: str = "xy", **k) -> GeoType:
    return GeoType("geometrycollection", dim, **k)


def box(dim: str = "xy", **k) -> GeoType:
    return GeoType("box", dim, **k)


def geometry(**k) -> GeoType:
    return GeoType("geometry", **k)


def wkb(**k) -> GeoType:
    return GeoType("wkb", **k)


def wkt(**k) -> GeoType:
    return GeoType("wkt", **k)


def _native_of(kind: T.DataType) -> tuple[int, str] | None:
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if isinstance(kind, T.StructType):
        names = "".join(f.name for f in kind.fields)
        if names in DIMS and all(isinstance(f.dataType, T.DoubleType) for f in kind.fields):
            return depth, names
    return None


def infer(field: T.StructField) -> GeoType:
    """The geometry type of a field: by its metadata; else by its storage: structs of two, three (always z) or four doubles are points, binary is WKB, text is WKT."""
    meta = field.metadata or {}
    if "geo" in meta:
        found = GeoType(**json.loads(meta["geo"]))
        if found.storage != field.dataType:
            raise GeoError(f"column {field.name}: {found.kind} is not stored as {field.dataType.simpleString()}")
        return found
    kind = field.dataType
    if isinstance(kind, T.BinaryType):
        return GeoType("wkb")
    if isinstance(kind, T.StringType):
        return GeoType("wkt")
    if isinstance(kind, T.StructType) and 2 <= len(kind.fields) <= 4 and all(isinstance(f.dataType, T.DoubleType) for f in kind.fields):
        return GeoType("point", ("xy", "xyz", "xyzm")[len(kind.fields) - 2])
    raise GeoError(f"column {field.name} of type {field.dataType.simpleString()} is no geometry")


@dataclass(frozen=True)
class Geo:
    """A geometry column and its type: what the functions take and return."""

    column: Column
    type: GeoType

    def alias(self, name: str) -> Column:
        """The column under a name, with the type in its metadata."""
        return self.column.cast(self.type.storage).alias(name, metadata=self.type.metadata())


def geometry_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "geo" in (f.metadata or {})]


def geo(df: DataFrame, name: str | None = None, kind: GeoType | None = None) -> Geo:
    """A geometry column of df. Without a name there must be just one; kind overrules what the schema says."""
    if name is None:
        names = geometry_columns(df)
        if len(names) != 1:
            raise GeoError("no geometry column" if not names else f"several geometry columns, name one: {', '.join(names)}")
        name = names[0]
    return Geo(F.col(f"`{name}`") if "." not in name else F.col(name), kind or infer(df.schema[name]))


def with_type(df: DataFrame, name: str, kind: GeoType) -> DataFrame:
    """df with the column's type in its metadata."""
    return df.withColumn(name, Geo(F.col(f"`{name}`"), kind).alias(name))


def check_same(a: Geo, b: Geo) -> None:
    if not a.type.same_reference(b.type):
        raise GeoError("the geometries have different coordinate reference systems or edges")


def free_name(*dfs: DataFrame) -> str:
    """What no column's name of these starts with, whatever its case."""
    taken, name = [c.lower() for df in dfs for c in df.columns], "_t"
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name
