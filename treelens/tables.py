"""Tables in the folder that driver and executors share: what cuts a job's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session gets a folder made up."""
    if base := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="treelens-"))
    return _own_folder[0]


def _hadoop_path(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    there, system = _hadoop_path(spark, path)
    system.deleteOnExit(there)
    return path


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df and read it back: what follows neither recomputes it nor needs the executors that made it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote and that nothing will read again."""
    for table in tables:
        there, system = _hadoop_path(table.sparkSession, table._cut_at)
        system.delete(there, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of a given name, in any store that Spark can write."""
    there, system = _hadoop_path(spark, path)
    out = system.create(there, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """One small file, also of a name that Spark's readers pass over because it starts with a dot."""
    there, system = _hadoop_path(spark, path)
    stream = system.open(there)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    """Whether there is a file, or a folder, in any store that Spark reads."""
    there, system = _hadoop_path(spark, path)
    return system.exists(there) and (not folder or system.getFileStatus(there).isDirectory())
