"""Files by any path that Spark reads: listing, reading and writing through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Names of Hadoop's file systems that Arrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(path: str) -> str:
    """The address by which Arrow's file systems, which tasks write with, know a path that Spark reads."""
    if path.startswith("file:"):
        return "file://" + path.removeprefix("file:").replace("///", "/", 1) if not path.startswith("file:///") else path
    scheme, colon, rest = path.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}://{rest}" if colon else f"file://{path}"


def list_files(spark: SparkSession, paths: str | list[str], suffix: str = "") -> list[str]:
    """The files of paths, folders and patterns, in order; hidden ones left out."""
    out: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        fs, p = _fs(spark, path)
        found = fs.globStatus(p)
        if not found:
            raise FileNotFoundError(path)
        todo = [s for s in found]
        while todo:
            s = todo.pop()
            name = s.getPath().getName()
            if s.isDirectory():
                todo += [x for x in fs.listStatus(s.getPath()) if not x.getPath().getName().startswith(("_", "."))]
            elif name.endswith(suffix):
                out.append(s.getPath().toString())
    return sorted(out)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, from the driver."""
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_bytes(spark: SparkSession, path: str, limit: int | None = None) -> bytes:
    """A small file, or its first bytes, on the driver."""
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        n = fs.getFileStatus(p).getLen() if limit is None else min(limit, fs.getFileStatus(p).getLen())
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(n)))
    finally:
        stream.close()


def read_range(spark: SparkSession, path: str, start: int, length: int) -> bytes:
    """A few bytes out of a file, on the driver; less at its end."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        n = max(0, min(length, fs.getFileStatus(p).getLen() - start))
        stream.seek(start)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(n)))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
