"""Sharding by rendezvous hashing over weighted shards.

Every shard draws a score for a key, ``weight / -ln(u)`` with u in (0, 1) from a hash of key and
shard; the highest score has the key. So the key and the shards alone decide, shards get keys in
proportion to their weights, and a further shard takes keys only into itself: a key moves if and
only if the new shard's score is the highest, for an expected 1/(n+1) of all keys.

DataFrame functions only. Defined results: a null key is a key like any other; a null text has
no bytes, size 16 and crc32 0; rows repeated or tied in their key go to the same shard and get
slots of their own; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelens.llm.common import cut, pick

#: Bytes a record takes besides its text.
RECORD_OVERHEAD = 16


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    # 52 bits, so that the 0.5 is exact and u is never 0 or 1
    bits = F.shiftrightunsigned(F.xxhash64(key, shard, F.lit(seed)), 12)
    return weight / -F.ln((bits.cast("double") + 0.5) * 2.0**-52)


def assign(df: DataFrame, key: str, weights: list[float], seed: int = 0, into: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add the shard of each row's key; ``grown`` names a column for its shard if one more shard of grown_weight came.

    Ties of scores, which need equal hashes, go to the lowest shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    scores = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, i: F.struct(_score(F.col(key), i, w, seed).alias("score"), (-i).alias("shard")))
    out = df.withColumn("__best", F.array_max(scores)).withColumn(into, -F.col("__best.shard"))
    if grown:
        n = len(weights)
        more = _score(F.col(key), F.lit(n), F.lit(float(grown_weight)), seed)
        out = out.withColumn(grown, F.when(more > F.col("__best.score"), F.lit(n)).otherwise(F.col(into)))
    return out.drop("__best")


def number_slots(rows: DataFrame, by: str, order: list[str], rows_each: int = 100_000) -> DataFrame:
    """Add ``slot``, gapless from 0 within each value of ``by``.

    A shard holds a share of all rows, so it isn't sorted in one task: its rows are dealt by a
    hash of the first order column over as many buckets as keep about rows_each each, numbered
    there, and moved by the sizes of the buckets before. ``rows`` must be a written table.
    """
    total, values = rows.count(), rows.agg(F.approx_count_distinct(by)).first()[0]
    buckets = max(1, math.ceil(total / max(1, values) / rows_each))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(17), order[0]), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(by, "__bucket").orderBy(*order)
    numbered = dealt.withColumn("__rn", F.row_number().over(within))
    return numbered.join(starts, [by, "__bucket"]).withColumn("slot", F.col("__start") + F.col("__rn") - 1).drop("__bucket", "__start", "__rn")


def shard_documents(docs: DataFrame, n_shards: int = 40, weights: list[float] | None = None, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign(slim, "doc_id", weights or [1.0] * n_shards, seed, "shard", "grown_shard")
    slots = number_slots(cut(placed, "shards"), "shard", ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id", seed: int = 0, files_each: int = 1) -> None:
    """Write whole records as Parquet in one folder a shard, of files_each files at most."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    placed = assign(docs.select(F.col(f"`{key}`").alias("__key"), record), "__key", weights, seed, "__shard")
    dealt = placed.withColumn("__part", F.pmod(F.xxhash64(F.lit(23), "__key"), F.lit(files_each)))
    dealt.repartition(len(weights) * files_each, "__shard", "__part").select("record", F.col("__shard").alias("shard")).write.partitionBy("shard").parquet(path)
