"""What the corpus operators share: column picking, tables in the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.tables import discard, scratch, shared_dir  # noqa: F401  used by the operators

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Slim rows that a file may as well hold; a text counts as TEXT of them.
ROWS_EACH, TEXT = 50_000, 10
#: Settings while a table is written.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "20000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name and first place.

    Any other column is left out, so one whose name clashes with an operator's own names, or
    differs from them in case only, can't get in the way.
    """
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    if missing := [name for name in names if name not in at]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[name]}").alias(name) for name in names])


def cut(df: DataFrame, what: str = "table", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: what follows neither recomputes it nor needs the executors that made it.

    ``rows`` says about how many slim rows it may have: then few files do for a small table, however many shuffle partitions there are.
    Nothing reads the shuffles of the writing again, so they go when it ends; batches for Python are small meanwhile.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_EACH)))
    was = {name: spark.conf.get(name) for name in _WRITING}
    for name, value in _WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def release() -> None:
    """Give memory that a worker has freed back to the system: it lives on, idle, after its task."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows and about so many bytes, one row at least, so that what a worker makes of them stays small."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, max(1, min(part.num_rows // 2, part.num_rows * size // part.nbytes)))
            yield part
            at += part.num_rows
    release()


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "inner", share: int = 10_000) -> DataFrame:
    """rows joined to groups, which has one row a key and in n how many of the rows have it; both are written tables.

    Rows of keys that hold more than one in ``share`` of them stay where they are, and their groups, fewer than share, are sent to all
    executors; the other rows are shuffled by key. So no key gathers its rows in one task.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * share > F.lit(total)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(left.join(cold, key, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
