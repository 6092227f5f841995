"""Durable intermediates in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where that is unset and all runs on this machine (tests), else RuntimeError."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            where = tempfile.mkdtemp(prefix="strandline-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """df written to the shared folder and read again: cuts its lineage, and survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() has written, once nothing reads it any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _file_system(spark: SparkSession, path: str):
    """The file system of path, and path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; FileExistsError if it is there already, so that of several writers one wins."""
    fs, p = _file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = _file_system(spark, path)
    with_lines = spark._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(p)
    try:
        return with_lines.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    fs, p = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def bounded_broadcast(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if its counted rows prove that it stays under limit; else unchanged, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def write_file(lines: DataFrame, path: str) -> str:
    """Writes lines (value) in their order as one text file at path, by one task that holds none of them."""
    spark = lines.sparkSession
    folder = f"{path}-{uuid.uuid4().hex}"
    lines.select("value").coalesce(1).write.text(folder)
    p = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = p(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(p(path).getParent())
    part = next((f.getPath() for f in fs.listStatus(p(folder)) if f.getPath().getName().startswith("part-")), None)
    if part is None:
        fs.create(p(path)).close()
    elif not fs.rename(part, p(path)):
        raise FileExistsError(path)
    fs.delete(p(folder), True)
    return path


def spread(df: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """df dealt out over all cores if its scan is estimated to give fewer partitions than there are cores, or, where part_bytes
    is given, partitions of more bytes of its files than that.

    A file of one row group is one task, however many cores wait; tables beyond that are left as they are scanned. A bound
    is for steps that sort what comes of a partition, so that no task's share grows with the table.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    scanned = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    parts = max(cores, -(-size // part_bytes) if part_bytes else 0)
    return df.repartition(parts) if size < parts * scanned else df
