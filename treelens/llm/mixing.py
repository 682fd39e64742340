"""Mixing sources to target weights by Sainte-Laguë apportionment.

Blocks of equal size in words are seats. They go to sources by highest quotients target/(2k+1),
and within a source to its shards by highest quotients of their sizes, which gives whole quotas.
A shard's documents stand in an order that a seeded hash gives them; the shard takes its quota of
blocks one after another from a seeded place of that ring. So a quota of q blocks takes exactly q
blocks of words, every word floor or ceil of quota over size times, in a seeded choice that any
rerun makes again.

A source may hold a third of all rows: it is spread over shards of bounded size, up to MAX_SHARDS,
and no task holds more than one shard. Only the sources' sums come to the driver, refused beyond
max_sources. Defined results: null texts and texts without a word have size 0 and take 0; a text of any length counts whole; a null
source is a source of its own, last; repeated rows are documents of their own; an empty table gives
no rows; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelens.llm.common import WORD, cut, pick

#: Weights in the order of the sources, repeating; times its size that a source may be taken.
WEIGHTS, MAX_REPEATS = (5.0, 2.0, 1.0), 3
MAX_SHARDS = 4096
#: Sources up to which their plan, of some fifty bytes each, is sent to all executors; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: list[int], weights: list[float], total: float | None = None, repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of total by weight, none above repeats times its size; the excess goes to the others by weight."""
    rest = float(sum(sizes)) if total is None else float(total)
    out, weight = [0.0] * len(sizes), sum(weights)
    # The excess only raises what the others get, so sources reach their limits in the order of size by weight.
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    for n, i in enumerate(order):
        if rest * weights[i] <= repeats * sizes[i] * weight:
            for j in order[n:]:
                out[j] = rest * weights[j] / weight
            break
        out[i] = float(repeats * sizes[i])
        rest, weight = rest - out[i], weight - weights[i]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes/(2k+1); ties go to the earlier party.

    The number of quotients at or above a bound is known without listing them, so the bound is
    found by halving, and only the last few seats are dealt one by one.
    """
    v = np.asarray(votes, dtype=float)
    if seats <= 0 or not (v > 0).any():
        return [0] * len(votes)
    low, high = v.max() / (2 * seats + 2), 2 * v.max() + 1  # at low the largest alone has enough
    for _ in range(200):
        middle = (low + high) / 2
        if np.floor((v / middle + 1) / 2).sum() > seats:
            low = middle
        else:
            high = middle
    got = np.floor((v / high + 1) / 2).astype(int)
    heap = [(-x / (2 * k + 1), i) for i, (x, k) in enumerate(zip(v, got, strict=True)) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-v[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def seats_within(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients, no party above its most: what a party can't take the others get by their quotients."""
    got, free = [0] * len(votes), list(range(len(votes)))
    while free:
        dealt = dict(zip(free, sainte_lague([votes[i] for i in free], seats), strict=True))
        over = [i for i in free if dealt[i] > most[i]]
        for i in over or free:
            got[i] = min(dealt[i], most[i])
        if not over:
            break
        seats -= sum(got[i] for i in over)
        full = set(over)
        free = [i for i in free if i not in full]
    return got


def _quotas_of_shards(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("shard")
    return group.assign(quota=np.array(sainte_lague(group["shard_size"].tolist(), int(group["seats"].iloc[0])), dtype="int64"))[["skey", "shard", "shard_size", "quota"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = 16, seed: int = 0, share: float = 1.0, docs_each: int = 2000, max_sources: int = 1_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and how: copies of the whole, and up to two spans of words [from_k, to_k).

    ``keep`` names further columns of docs to carry through (they are shuffled with the slim rows).
    """
    sized = pick(docs, "doc_id", "source", "text", *keep).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    slim = cut(sized, "sizes")
    per_source = slim.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = per_source.limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources.sort(key=lambda r: (r.skey == "n", r.skey))
    sizes = [r.source_size for r in sources]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], sum(sizes) * share)
    seats = seats_within(aims, round(sum(aims) / block_words), [MAX_REPEATS * s // block_words for s in sizes])
    plan = docs.sparkSession.createDataFrame(
        [(r.skey, r.source_size, aim, n, min(MAX_SHARDS, max(1, math.ceil(r.n_docs / docs_each)))) for r, aim, n in zip(sources, aims, seats, strict=True)],
        "skey string, source_size long, target double, seats long, n_shards int",
    )
    if len(sources) <= BROADCAST_SOURCES:  # a hot source's rows stay where they are
        plan = F.broadcast(plan)
    dealt = slim.join(plan, "skey").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards")).cast("int"))
    per_shard = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("shard_size"), F.max("seats").alias("seats"))
    quotas = per_shard.groupBy("skey").applyInPandas(_quotas_of_shards, "skey string, shard int, shard_size long, quota long")
    order = Window.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("until", F.sum("size").over(order)).join(quotas, ["skey", "shard"])
    # The ring: words wanted, whole rounds of it, and the rest from a seeded place on.
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * MAX_REPEATS)
    ring = placed.withColumn("size_or_1", F.greatest("shard_size", F.lit(1))).withColumn("words", words)
    ring = ring.withColumn("rounds", F.expr("words div size_or_1")).withColumn("rest", F.expr("words % size_or_1"))
    ring = ring.withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 2), "skey", "shard"), F.col("size_or_1"))).withColumn("begin", F.col("until") - F.col("size"))
    span = lambda a, b: (F.least(F.greatest(a - F.col("begin"), F.lit(0)), F.col("size")), F.least(F.greatest(b - F.col("begin"), F.lit(0)), F.col("size")))
    from_1, to_1 = span(F.col("start"), F.least(F.col("start") + F.col("rest"), F.col("shard_size")))
    from_2, to_2 = span(F.lit(0), F.greatest(F.col("start") + F.col("rest") - F.col("shard_size"), F.lit(0)))
    out = ring.withColumns({"copies": F.col("rounds"), "from_1": from_1, "to_1": to_1, "from_2": from_2, "to_2": to_2})
    taken = F.col("copies") * F.col("size") + (F.col("to_1") - F.col("from_1")) + (F.col("to_2") - F.col("from_2"))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "copies", "from_1", "to_1", "from_2", "to_2", F.col("source").alias("source_name"), *keep)
