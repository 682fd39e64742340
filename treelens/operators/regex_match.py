"""Whole-file regular-expression rules and the folds over their hits (RGX1-5, AGG2, FLT9-10).

A rule is a set of patterns. It is found when each of its patterns matches at least one file,
not necessarily the same one: a relational division. A text is one record, so a pattern may
span lines; ``(?s)`` is never implied.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Syntax of PCRE that java.util.regex lacks or reads differently.
_UNSUPPORTED = re.compile(r"\\K|\(\?R\)|\(\?\d+\)|\(\?&|\(\*[A-Z]|\(\?\||\(\?P[<>=]|\\g\{?\d")


class UnsupportedPattern(ValueError):
    """A pattern that this engine would read in another way than the rule's author meant."""


def check_pattern(pattern: str) -> str:
    if found := _UNSUPPORTED.search(pattern):
        raise UnsupportedPattern(f"{found[0]!r} isn't supported in {pattern!r}")
    return pattern


#: Patterns of a pack; it is read by the driver, which makes one expression of it.
MAX_PATTERNS = 100_000


def usable(patterns: DataFrame) -> tuple[list[tuple[str, int, str]], list[tuple[str, int, str]]]:
    """(rule_id, pat_id, pattern) of the patterns that can be used, and (rule_id, pat_id, reason) of the others."""
    rows = patterns.select("rule_id", "pat_id", "pattern").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    java = patterns.sparkSession.sparkContext._jvm.java.util.regex.Pattern
    good, bad = [], []
    for r in rows:
        try:
            java.compile(check_pattern(r.pattern))
            good.append((r.rule_id, r.pat_id, r.pattern))
        except UnsupportedPattern as wrong:
            bad.append((r.rule_id, r.pat_id, str(wrong)))
        except (Py4JJavaError, PySparkException) as wrong:
            bad.append((r.rule_id, r.pat_id, str(wrong).split("\n")[0]))
    return good, bad


def skipped(patterns: DataFrame) -> DataFrame:
    """(rule_id, pat_id, reason) of the patterns that can't be used: their rules are never found."""
    return patterns.sparkSession.createDataFrame(usable(patterns)[1], "rule_id string, pat_id int, reason string")


def pattern_hits(files: DataFrame, patterns: DataFrame, hints: DataFrame | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """(rule_id, pat_id, path) of each match; a pattern that can't be used matches nothing.

    ``patterns`` (rule_id, pat_id, pattern) is a rule pack. The files are read once: the
    pack comes as one array of expressions, so that the work is one
    pass per text instead of a nested-loop join's row per pair. ``hints`` (rule_id, path) restrict
    each rule to the files it names, by an equi-join on path.
    """
    pack, _ = usable(patterns)
    if hints is not None:
        known = patterns.sparkSession.createDataFrame(pack, "rule_id string, pat_id int, pattern string")
        named = hints.select("rule_id", F.col("path").alias(path)).distinct().join(F.broadcast(known), "rule_id")  # MAX_PATTERNS at most
        both = files.select(path, content).join(named, path)
        return both.where(F.expr(f"`{content}` rlike pattern")).select("rule_id", "pat_id", F.col(path).alias("path"))
    if not pack:
        return files.select(F.lit("").alias("rule_id"), F.lit(0).alias("pat_id"), F.col(path).alias("path")).where(F.lit(False))
    hits = F.array(*[F.when(F.col(content).rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(i).alias("pat_id"))) for r, i, p in pack])
    rows = files.select(F.col(path).alias("path"), F.explode(F.array_compact(hits)).alias("hit"))
    return rows.select("hit.rule_id", "hit.pat_id", "path")


def line_hits(files: DataFrame, pattern: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line) of the lines that a pattern matches, counted from 1."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n")).alias("at", "text"))
    return lines.where(F.col("text").rlike(check_pattern(pattern))).select("path", (F.col("at") + 1).cast("int").alias("line"))


def division(hits: DataFrame, patterns: DataFrame) -> DataFrame:
    """(rule_id, n_patterns) of the rules all of whose patterns have a hit somewhere."""
    wanted = patterns.groupBy("rule_id").agg(F.countDistinct("pat_id").alias("n_patterns"))
    got = hits.groupBy("rule_id").agg(F.countDistinct("pat_id").alias("n_matched"))
    return got.join(wanted, "rule_id").where("n_matched = n_patterns").select("rule_id", "n_patterns")


def scanned_files(files: DataFrame, patterns: DataFrame, hints: DataFrame | None = None, path: str = "path") -> DataFrame:
    """(rule_id, path) of the files that each rule is held against: all of them, or those that it names and that exist."""
    rules = patterns.select("rule_id").distinct()
    if hints is None:
        return files.select(path).crossJoin(F.broadcast(rules.limit(MAX_PATTERNS))).select("rule_id", F.col(path).alias("path"))
    return files.select(F.col(path).alias("path")).join(hints.select("rule_id", "path").distinct(), "path").join(F.broadcast(rules.limit(MAX_PATTERNS)), "rule_id", "left_semi").select("rule_id", "path")


def matched_files(hits: DataFrame, found: DataFrame) -> DataFrame:
    """(rule_id, path): the union over a found rule's patterns of the files matched."""
    return hits.join(found.select("rule_id"), "rule_id", "left_semi").select("rule_id", "path").distinct()
