"""Exchange with Python geometry libraries, by WKB; each is imported when it is used, and none is needed otherwise.

These collect to, or start from, the driver's memory: they are for results and
small inputs. Large tables go through files.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernel
from tessera.types import Geo, GeoError, GeoType, geo


def _library(name: str) -> Any:
    try:
        return importlib.import_module(name)
    except ImportError:
        raise GeoError(f"{name} is not installed") from None


def _reference(crs: Any) -> dict[str, str | None]:
    """crs and crs_form of what a library calls a CRS: text, PROJJSON, or an object that gives either."""
    if crs is None:
        return {"crs": None, "crs_form": None}
    if isinstance(crs, str):
        return {"crs": crs, "crs_form": "authority_code" if ":" in crs and "[" not in crs else None}
    authority = crs.to_authority() if hasattr(crs, "to_authority") else None
    if authority:
        return {"crs": ":".join(authority), "crs_form": "authority_code"}
    return {"crs": json.dumps(crs.to_json_dict() if hasattr(crs, "to_json_dict") else crs, sort_keys=True), "crs_form": "projjson"}


def _mixed(df: DataFrame, name: str, crs: Any) -> DataFrame:
    return df.withColumn(name, Geo(F.col(f"`{name}`").cast("binary"), GeoType("geometry", **_reference(crs))).alias(name))


def from_geopandas(spark: SparkSession, frame: Any) -> DataFrame:
    """A GeoDataFrame's columns, its geometries as a mixed column."""
    name = frame.geometry.name
    plain = frame.drop(columns=[name]).copy()
    plain[name] = [None if x is None else bytes(x) for x in frame.geometry.to_wkb()]
    return _mixed(spark.createDataFrame(plain), name, frame.crs)


def from_shapely(spark: SparkSession, shapes: Iterable[Any], crs: Any = None, name: str = "geometry") -> DataFrame:
    """place and a mixed column of shapes (objects with wkb, or None)."""
    return _mixed(spark.createDataFrame([(k, None if s is None else bytearray(s.wkb)) for k, s in enumerate(shapes)], f"place long, `{name}` binary"), name, crs)


def read_pyogrio(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """A layer that pyogrio reads on the driver."""
    meta, table = _library("pyogrio").read_arrow(path, **options)
    name = meta.get("geometry_name") or "wkb_geometry"
    return _mixed(spark.createDataFrame(table), name, meta.get("crs"))


def _collected(df: DataFrame, name: str | None) -> tuple[Any, str, str | None]:
    g = geo(df, name)
    name = name or next(f.name for f in df.schema.fields if "geo" in (f.metadata or {}))
    out = df.withColumn(name, kernel.to_wkb(g).column).toPandas()
    out[name] = [None if x is None else bytes(x) for x in out[name]]
    return out, name, g.type.crs


def to_geopandas(df: DataFrame, name: str | None = None) -> Any:
    """A GeoDataFrame of all rows."""
    library = _library("geopandas")
    plain, name, crs = _collected(df, name)
    return library.GeoDataFrame(plain.drop(columns=[name]), geometry=library.GeoSeries.from_wkb(plain[name], crs=crs))


def to_shapely(df: DataFrame, name: str | None = None) -> list[Any]:
    """All geometries as shapely objects."""
    library = _library("shapely")
    plain, name, _ = _collected(df, name)
    return [None if x is None else library.from_wkb(x) for x in plain[name]]
