"""CSV with WKT, GeoJSON and GeoJSON lines; tables of a database with extended WKB."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import kernel
from tessera.types import GeoError, GeoType, geo, geometry, geometry_columns


def _geometry_name(df: DataFrame, name: str | None) -> str:
    names = geometry_columns(df)
    if name is not None:
        return name
    if len(names) != 1:
        raise GeoError(f"one geometry column is needed, not {len(names)}")
    return names[0]


# CSV


def read_csv(spark: SparkSession, path: str, kind: GeoType | None = None, geometry_name: str | None = None, schema: T.StructType | str | None = None, header: bool = True, **options) -> DataFrame:
    """CSV whose geometry column, by name or called geometry in any case, holds WKT. Without a schema all others are strings."""
    reader = spark.read.option("header", header).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    found = next((c for c in df.columns if c == geometry_name), None) if geometry_name else next((c for c in df.columns if c.lower() == "geometry"), None)
    if found is None:
        raise GeoError(f"no column {geometry_name or 'geometry'}")
    return df.withColumn(found, kernel.from_wkt(F.col(f"`{found}`"), kind or geometry()).alias(found))


def write_csv(df: DataFrame, path: str, mode: str = "error", **options) -> None:
    """Every geometry column as WKT."""
    for c in geometry_columns(df):
        df = df.withColumn(c, kernel.to_wkt(geo(df, c)).column)
    df.write.option("header", True).options(**options).mode(mode).csv(path)


# GeoJSON


def _feature(df: DataFrame, name: str) -> Column:
    """One feature as text; a column id is hoisted, the others are properties."""
    g = geo(df, name)
    shape = kernel.as_geojson(g)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (name, "id")]
    props = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    parts = [F.lit('{"type":"Feature",')]
    if "id" in df.columns:
        wrapped = F.to_json(F.struct(F.col("id")), {"ignoreNullFields": "false"})
        parts += [F.substring(wrapped, F.lit(2), F.length(wrapped) - 2), F.lit(",")]
    parts += [F.lit('"geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), props, F.lit("}")]
    return F.concat(*parts)


def write_geojson_lines(df: DataFrame, path: str, name: str | None = None, mode: str = "error") -> None:
    """One feature a line, a file for each partition."""
    name = _geometry_name(df, name)
    df.select(_feature(df, name).alias("value")).write.mode(mode).text(path)


def write_geojson(df: DataFrame, path: str, name: str | None = None) -> None:
    """A folder of feature collections, one for each partition: each file is a whole GeoJSON document.

    A single document cannot be written by several tasks; df.coalesce(1) gives
    one file.
    """
    name = _geometry_name(df, name)
    rows = df.select(_feature(df, name).alias("value"))

    def wrap(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                out.append(('{"type":"FeatureCollection","features":[\n' if first else ",\n") + v)
                first = False
            if out:
                yield pa.record_batch([pa.array(out)], ["value"])
        yield pa.record_batch([pa.array(['{"type":"FeatureCollection","features":[]}' if first else "\n]}"])], ["value"])

    rows.mapInArrow(wrap, "value string").write.option("lineSep", "\n").text(path)


_FEATURE = "type string, id string, geometry string, properties string"


def _from_features(features: DataFrame, kind: GeoType, properties: T.StructType | str | None) -> DataFrame:
    g = kernel.from_geojson(F.col("geometry"), kind)
    if properties is None:
        properties = _infer(features.select("properties").filter("properties is not null"))
    df = features.select("id", F.from_json("properties", properties).alias("p"), g.alias("geometry"))
    names = [f.name for f in df.schema["p"].dataType.fields]
    keep = [F.col("id")] if "id" not in names else []
    return df.select(*keep, *[F.col(f"p.`{n}`").alias(n) for n in names], "geometry")


def _infer(sample: DataFrame) -> T.StructType:
    """The properties' schema, merged over all features in a distributed way."""
    spark = sample.sparkSession
    texts = getattr(sample._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(texts).schema().json()))


def read_geojson_lines(spark: SparkSession, path: str, kind: GeoType | None = None, properties: T.StructType | str | None = None) -> DataFrame:
    """One feature a line. properties: their schema; inferred if not given."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    f = lines.select(F.from_json("value", _FEATURE).alias("f")).select("f.*")
    return _from_features(f, kind or geometry(), properties)


def read_geojson(spark: SparkSession, path: str, kind: GeoType | None = None, properties: T.StructType | str | None = None) -> DataFrame:
    """Feature collections, one document a file; a document is parsed by one task."""
    docs = spark.read.text(path, wholetext=True)
    f = docs.select(F.explode(F.from_json("value", "features array<struct<type:string,id:string,geometry:string,properties:string>>")["features"]).alias("f")).select("f.*")
    return _from_features(f, kind or geometry(), properties)


# databases


def from_ewkb(df: DataFrame, name: str, kind: GeoType | None = None) -> DataFrame:
    """A column of extended WKB, as bytes or hexadecimal text, as a geometry column."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        c = F.unhex(c)
    return df.withColumn(name, kernel.from_wkb(c, kind or geometry()).alias(name))


def read_postgis(spark: SparkSession, url: str, query: str, geometry_name: str = "geom", kind: GeoType | None = None, **options) -> DataFrame:
    """A query's rows over JDBC; its driver must be on the class path. options as spark.read.jdbc's, for example partitionColumn and numPartitions."""
    df = spark.read.format("jdbc").option("url", url).option("query" if "partitionColumn" not in options else "dbtable", query).options(**options).load()
    return from_ewkb(df, geometry_name, kind)

