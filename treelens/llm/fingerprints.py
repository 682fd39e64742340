"""Bottom-k sketches of word shingles.

A document's shingles (five words, lower-cased A-Z) are hashed to 48 bits; the k smallest distinct
hashes are its sketch. The sketch of a union is the k smallest of two sketches' union, so parts
merge in any order. Of two sketches, the share of the union's k smallest that lie in both estimates
resemblance; containment and the number of distinct shingles follow. Sets of fewer than k are
kept whole and compared exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm import shingles
from treelens.llm.common import partitions, pick, slices

K, WIDTH, BITS = 128, 5, 48
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_estimate double, containment_edited double"


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of the distinct 64-bit hashes, cut to 48 bits."""
    return np.unique(hashes >> np.uint64(64 - BITS))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of the sets that a and b are sketches of."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """How many shingles the set has: exact under k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The Jaccard similarity; two empty sets are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's set that lies in b's, from resemblance and sizes."""
    n, both = distinct(a, k), distinct(merge(a, b, k), k)
    return 1.0 if not n else min(1.0, resemblance(a, b, k) * both / n)


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.hstack((np.zeros((len(raw), 2), np.uint8), raw)).copy().view(">u8").reshape(-1).astype(np.uint64)


def sketches(texts: list[str], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    return [sketch(shingles.of(w, width), k) for w in shingles.words([t.encode() for t in texts])]


def fingerprint_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([encode(s) for s in sketches(texts)], pa.string())], names=["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document: one pass, no shuffle."""
    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(fingerprint_column, "doc_id long, fingerprint string")


def _range_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Each doc_id's range; null ones are in the first."""
    low = np.iinfo(np.int64).min
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, ids.fill_null(low).to_numpy(zero_copy_only=False), "right")).astype(np.int32)


def _ranges(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_range_of(batch["doc_id"], bounds))], names=["doc_id", "range"])

    return run


def _deal(bounds: np.ndarray, heads: dict):
    """Rows with their range of doc_ids; a range's first document goes to the range before it as well, as the one that follows its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ranges = batch["doc_id"].to_pylist(), _range_of(batch["doc_id"], bounds)
            after = [i for i, d in enumerate(ids) if d in heads]
            whole = pa.RecordBatch.from_arrays([pa.array(ranges), pa.array([False] * len(ids)), batch["doc_id"], batch["text"]], names=["range", "after", "doc_id", "text"])
            yield whole
            if after:
                extra = batch.take(pa.array(after))
                yield pa.RecordBatch.from_arrays([pa.array([heads[ids[i]] for i in after], pa.int32()), pa.array([True] * len(after)), extra["doc_id"], extra["text"]], names=["range", "after", "doc_id", "text"])

    return run


def _edit(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order, the following range's first document last: each row meets the next one."""
    last = None  # range, doc_id, text, sketch of a row that waits for its next
    for batch in slices(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        rows = list(zip(batch["range"].to_pylist(), batch["after"].to_pylist(), batch["doc_id"].to_pylist(), texts, sketches(texts), strict=True))
        pairs = []
        for at, after, doc_id, text, own in rows:
            if last is not None and last[0] == at:
                pairs.append((last, text, own))
            last = None if after else (at, doc_id, text, own)
        edited = [_edit(this[2], text) for this, text, _ in pairs]
        edited_sketches = sketches(edited)
        own = [this[3] for this, _, _ in pairs]
        columns = [
            pa.array([this[1] for this, _, _ in pairs], pa.int64()), pa.array([len(this[2]) for this, _, _ in pairs], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([encode(a) for a in own], pa.string()), pa.array([encode(a) for a in edited_sketches], pa.string()),
            pa.array([resemblance(a, b) for a, b in zip(own, edited_sketches, strict=True)], pa.float64()), pa.array([resemblance(a, b) for a, (_, _, b) in zip(own, pairs, strict=True)], pa.float64()),
            pa.array([distinct(a) for a in own], pa.float64()), pa.array([containment(a, b) for a, b in zip(own, edited_sketches, strict=True)], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])


def edited_fingerprints(docs: DataFrame, ranges_each: int = 4) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document.

    The edited text has its last quarter of characters replaced by as many (or all) first ones of the
    next document in ascending doc_id; after the last comes the first. Documents are dealt into
    ranges of doc_id, whose bounds are quantiles and need not be exact; each range is read in order
    by one task and gets a copy of the document that follows it.

    Defined results: a null text is empty; a text of any length is read whole, its shingles a few megabytes at a time; null doc_ids come first; rows tied in doc_id stand in the
    order of a hash of their texts; a sole document follows itself; two empty sketches are alike (1),
    an empty one and another are not (0); an empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    n = partitions(spark) * ranges_each
    quantiles = rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    bounds = sorted({ceil(q) for q in quantiles})
    ids = rows.select("doc_id").mapInArrow(_ranges(np.array(bounds, np.int64)), "doc_id long, range int")
    firsts = sorted((r["range"], r.nulls, r.low) for r in ids.groupBy("range").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect())
    heads = {(None if nulls else low): firsts[i - 1][0] for i, (_, nulls, low) in enumerate(firsts)}
    dealt = rows.mapInArrow(_deal(np.array(bounds, np.int64), heads), "range int, after boolean, doc_id long, text string")
    in_order = dealt.repartition(partitions(spark), "range").sortWithinPartitions("range", "after", "doc_id", F.xxhash64("text"))
    return in_order.mapInArrow(_compare, SCHEMA)
