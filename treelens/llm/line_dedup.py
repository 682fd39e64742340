"""Line dedup by content-defined chunks of lines.

A rolling hash goes over the line hashes of every two neighbouring lines. A chunk is a run of such
pairs that stand elsewhere before, so its boundaries are where that ends: they are chosen by the lines alone,
move with them, and need not agree with any grid, whatever stands around the passage.
Pairs whose hash occurs at two places or more are candidates; they count as repeated only if their
bytes are equal. The first place (smallest doc_id, then place in the text) keeps a pair, the others
lose its lines; a pair that overlaps the first place in its own text isn't a repeat. So of a passage
each line stays at its first place, and every later copy of two lines or more goes whole, even if
its last lines and the line after them are the first place of another passage.

DataFrame functions only. Slim rows of (document, place, hash) find the candidates; those with very common hashes
aren't shuffled; texts are shuffled once, to meet their list of candidate pairs, and the pairs' bytes are compared by
partial minimum and maximum, so no group of copies gathers anywhere.

Defined results: rows equal in doc_id and text are one document, and each gets the same cleaned text;
null doc_ids come last; a null text stays null and has no lines; blank lines are lines; a single line
that is repeated without a neighbour stays; a pair whose hash is shared by different bytes is left alone;
texts and lines of any length are read whole; a document may lose all its lines and then has an empty text; a chunk removed is a run of lines removed;
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.llm.common import TEXT, cut, discard, join_groups, pick

#: Lines of a window that is held against the others: the shortest passage that goes.
MIN_LINES = 2
_NONE = "array<struct<at:int,h:bigint,again:boolean>>"


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once instead of in each turn of body's lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with_lines(text: Column, body) -> Column:
    return _bind(F.split(text, "\n", -1), body)


def _pairs(lines: Column) -> Column:
    """(at, h) of every MIN_LINES neighbouring lines."""
    places = F.when(F.size(lines) >= MIN_LINES, F.sequence(F.lit(0), F.size(lines) - MIN_LINES)).otherwise(F.array().cast("array<int>"))
    return _bind(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(h, i + k) for k in range(MIN_LINES)]).alias("h"))))


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without repeated passages, n_lines, n_lines_removed, n_chunks_removed; ``keep`` carries further columns."""
    rows = pick(docs, "doc_id", "text", *keep).withColumn("th", F.xxhash64("text"))
    slim = cut(rows.select("doc_id", "th", F.explode(_with_lines(F.col("text"), _pairs)).alias("c")).select("doc_id", "th", "c.at", "c.h"), "pairs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "at")
    groups = cut(slim.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last"), "repeated", slim.count() // 2)
    overlaps = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("at") < F.col("first.at") + MIN_LINES)
    candidates = join_groups(slim, groups, "h", "n").groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "h", (~overlaps).alias("again"))).alias("cand"))
    met = rows.join(candidates, rows.doc_id.eqNullSafe(candidates.doc_id) & (rows.th == candidates.th), "left").select(rows.doc_id, rows.th, "text", *keep, "cand")
    met = cut(met, "candidates", TEXT * rows.count())
    discard(groups)
    texts = _with_lines(F.col("text"), lambda lines: F.transform("cand", lambda c: F.struct(c["h"].alias("h"), F.array_join(F.slice(lines, c["at"] + 1, MIN_LINES), "\n").alias("bytes"))))
    compared = met.where("cand is not null").select(F.explode(texts).alias("c")).select("c.h", "c.bytes")
    differ = cut(compared.groupBy("h").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a != b").select("h"), "differ")
    again = F.transform(F.filter(F.coalesce("cand", F.array().cast(_NONE)), lambda c: c["again"]), lambda c: c["at"])
    if differ.isEmpty():
        discard(slim, differ)
        marked = met.withColumn("drop", again)
    else:  # hashes that different pairs share: their pairs stay
        stay = slim.join(differ, "h", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("at").alias("stay"))
        marked = met.join(stay, met.doc_id.eqNullSafe(stay.doc_id) & (met.th == stay.th), "left").select(met.doc_id, met.th, "text", *keep, "cand", F.array_except(again, F.coalesce("stay", F.array().cast("array<int>"))).alias("drop"))
    marked = marked.withColumn("gone", F.array_distinct(F.flatten(F.transform("drop", lambda i: F.array(*[i + k for k in range(MIN_LINES)])))))
    left = _with_lines(F.col("text"), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)))
    return marked.select(
        "doc_id",
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_lines_removed"),
        F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1))).cast("long").alias("n_chunks_removed"),
        *keep,
    )
