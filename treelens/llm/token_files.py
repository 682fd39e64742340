"""Token ids as Re-Pair shards in Parquet, in ascending order of doc_id, and back.

A range shuffle brings the documents into order. Each task encodes its range and writes shards of
about shard_ids ids as rows (part, seq, first and last documents, counts, bytes): Spark's writer
commits them, in any store that Spark can write. Shards decode by themselves, a document at a time
if need be.

Defined results: a null text is empty, so the document is its end id alone; null doc_ids come first;
rows tied in doc_id stand in the order of a hash of their texts, repeated rows each with ids of their
own; a document longer than a shard is a shard by itself; an empty table gives an empty file set
and no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelens.llm import tokens
from treelens.llm.common import partitions, pick, scratch, slices
from treelens.llm.grammar import Shard, pack_shard

SHARD_IDS = 1 << 20
FILES = "part int, seq int, n_docs int, n_ids long, blob binary"
ROWS = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _writer(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seq = tokens.encoder(path).encode_column, TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            blob = pack_shard(doc_ids, np.concatenate(held), np.concatenate(counts))
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (len(doc_ids), pa.int32()), (size, pa.int64()), (blob, pa.binary()))]
            doc_ids.clear(), held.clear(), counts.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_arrays(row, names=[f.split()[0] for f in FILES.split(", ")])

        for batch in slices(batches):
            ids, n = encode(batch["text"])
            ids, n = np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1
            upto, at, of = np.cumsum(n), 0, batch["doc_id"].to_pylist()
            while at < len(n):  # as many documents as the shard has room for, or one that no shard has room for
                done = int(upto[at - 1]) if at else 0
                end = max(int(np.searchsorted(upto, done + shard_ids - size, "right")), at + (not held))
                if end > at:
                    doc_ids += of[at:end]
                    held.append(ids[done : upto[end - 1]])
                    counts.append(n[at:end])
                    size += int(upto[end - 1]) - done
                at = end
                if at < len(n):
                    yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs (doc_id, text) and write the shards under path."""
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_writer(tokenizer, end_id, shard_ids), FILES).write.option("compression", "uncompressed").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, blob in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["blob"], strict=True):
            shard = Shard(blob.as_py())
            ids = shard.all_ids()
            ends = np.cumsum(shard.counts)
            starts = ends - shard.counts
            crcs = [tokens.crc(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.counts), pa.array(crcs, pa.int64())],
                names=[f.split()[0] for f in ROWS.split(", ")],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    A shard's start is the ids of the parts before, of which there are as many as the writing job
    had tasks, and of the shards before it in its part.
    """
    files = spark.read.schema(FILES).parquet(path)
    rows = files.select("part", "seq", "blob").mapInArrow(_reader, ROWS)
    sizes = files.select("part", "seq", "n_ids")
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("seq_start")).join(parts, "part")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("seq_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the files to the shared folder and return what they hold, read back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, shard_ids)
    return read_tokens(docs.sparkSession, path)
