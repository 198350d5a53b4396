"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\f\r"
#: One word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: The same set of separators.
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local runs a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of tables that materialize has written and discard has not deleted, in order.
_written: list[str] = []


#: A table of numbers is written in at most so many files a core, or as many as hold so many numbers each, if that is more.
FILES_A_CORE, NUMBERS_A_FILE = 2, 4_000_000


def materialize(df: DataFrame, name: str, numbers: int | None = None, arrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    numbers: how many numbers df is known to hold about; 0 for tables of a few
    numbers a document, made from written tables, which are far less than the
    texts. Such a table is written in fewer files than shuffles have
    partitions: else it would be tiny ones by the hundred, again and again. A
    task then has several partitions of what made df, so Python code of that
    stage must not tell them apart by the task. arrow: on a local file system
    Python tasks write it; for tables of flat rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    if numbers is not None:
        df = df.coalesce(max(FILES_A_CORE * spark.sparkContext.defaultParallelism, -(-numbers // NUMBERS_A_FILE)))
    if arrow and path.startswith("file:"):
        _write_local(df, "/" + path.removeprefix("file:").lstrip("/"))
    else:
        df.write.options(**_plain_files(spark)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _plain_files(spark: SparkSession) -> dict[str, str]:
    """Options of a write: without a file that marks success, and on a local file system without a file of check sums beside each (Parquet's pages have their own). Without native libraries Hadoop forks the JVM for each."""
    out = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
    if spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl") in (None, "org.apache.hadoop.fs.LocalFileSystem"):
        out |= {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    return out


def _write_local(df: DataFrame, folder: str) -> None:
    """Write df to a folder of a local (or mounted) file system from Python tasks, so that no JVM is forked. Of a task's attempts only the one that counts gets a name that readers see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq  # costs memory in each worker that does

        name, writer = f"part-{uuid.uuid4().hex}.parquet", None
        for b in batches:
            if b.num_rows:
                if writer is None:
                    os.makedirs(folder, exist_ok=True)
                    writer = pq.ParquetWriter(f"{folder}/_{name}", b.schema)
                writer.write_batch(b)
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([name])], ["name"])
        release_memory()

    names = df.mapInArrow(run, "name string").collect()  # a row a file
    os.makedirs(folder, exist_ok=True)
    for r in names:
        os.rename(f"{folder}/_{r[0]}", f"{folder}/{r[0]}")


def written() -> int:
    """How many tables there are that discard could delete."""
    return len(_written)


def discard(spark: SparkSession, start: int = 0, stop: int | None = None) -> None:
    """Deletes tables that materialize wrote, from the start-th up to the stop-th of them. Only for those that no result needs any more: results are computed late."""
    jvm = spark.sparkContext._jvm
    paths = _written[start:stop]
    del _written[start:stop]
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release_memory() -> None:
    """Gives memory back to the system at the end of a task: Python workers outlive it, idle ones beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors' JVMs collect all garbage, by a task a core: a heap that no full collection shrinks stays as large as it ever was, direct buffers stay with it, and Python workers need that memory. For the time between stages, when tasks hold nothing."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def id_hash_mod(c: Column, m: int) -> Column:
    """crc32 of the id's decimal text, mod m; null ids count as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows of a few numbers; df should be a written table. Otherwise joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
