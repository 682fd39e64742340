"""Queries of rule scanning over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.operators import regex_match
from treelens.plans import report

#: Synthetic rules of this repository: (rule, pattern number, pattern).
RULES = [
    ("R-LICENSE", 1, "[Ll]icense"),
    ("R-LICENSE", 2, "Version [0-9]"),
    ("R-MENU", 1, "[|] [a-z]+ [|]"),
    ("R-ABSENT", 1, "The "),
    ("R-ABSENT", 2, "BEGIN PRIVATE KEY"),
]
#: Rules with a pattern that can't be read: one that means something else in Java, one that is no expression.
BROKEN = [("R-OTHER", 1, r"a\Kb"), ("R-BROKEN", 1, "The "), ("R-BROKEN", 2, "([a-z")]
_VALUES = ", ".join(f"('{r}', {i}, '{p}')" for r, i, p in RULES)
_RULES_SQL = f"rules(rule_id, pat_id, pattern) AS (VALUES {_VALUES})"
_HITS_SQL = "hits AS (SELECT rule_id, pat_id, doc_id FROM rules JOIN documents ON regexp_matches(text, pattern))"
_FOUND_SQL = "found AS (SELECT rule_id, count(DISTINCT pat_id) AS n_patterns FROM hits GROUP BY rule_id HAVING count(DISTINCT pat_id) = (SELECT count(*) FROM rules r WHERE r.rule_id = hits.rule_id))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules(spark: SparkSession, rows=RULES) -> DataFrame:
    return spark.createDataFrame(rows, "rule_id string, pat_id int, pattern string")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))


def rule_scan_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_match.division(regex_match.pattern_hits(_files(spark, sf_dir), _rules(spark)), _rules(spark))


def rule_scan_matched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = regex_match.pattern_hits(_files(spark, sf_dir), _rules(spark))
    return regex_match.matched_files(hits, regex_match.division(hits, _rules(spark))).withColumnRenamed("path", "doc_id")


def rule_scan_scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files that the found rules were held against, and which of them matched."""
    files, rules = _files(spark, sf_dir), _rules(spark)
    found = report.findings(rules, rules, files, all_files=True)
    return report.with_scanned(found, regex_match.scanned_files(files, rules)).withColumnRenamed("path", "doc_id")


def bad_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that can't be used are told and their rules never found; the others are."""
    rules = _rules(spark, RULES + BROKEN)
    found = regex_match.division(regex_match.pattern_hits(_files(spark, sf_dir), rules), rules)
    return found.select("rule_id", F.lit("found").alias("state")).unionByName(regex_match.skipped(rules).select("rule_id", F.lit("skipped").alias("state")))


def _hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each quality a rule that names the documents labelled so, and one that there isn't."""
    labels = table(spark, sf_dir, "labels").groupBy("quality").agg(F.collect_list("doc_id").alias("files"))
    return labels.select(F.concat(F.lit("Q"), "quality").alias("rule_id"), F.array_append("files", F.lit(-1).cast("long")).alias("files"))


def hinted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are held against the files that they name: an equi-join, then the patterns, both of which must be found."""
    patterns = _rules(spark, [(q, i, p) for q in ("Q0", "Q1") for i, p in ((1, "[a-z]"), (2, "[|] [a-z]+"))])
    return report.findings(_hinted(spark, sf_dir), patterns, _files(spark, sf_dir)).withColumnRenamed("path", "doc_id")


def hinted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that rules name and that are there."""
    hints = _hinted(spark, sf_dir).select("rule_id", F.explode("files").alias("path"))
    return regex_match.scanned_files(_files(spark, sf_dir), _rules(spark, [("Q0", 1, "a"), ("Q1", 1, "a")]), hints).withColumnRenamed("path", "doc_id")


def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_match.line_hits(_files(spark, sf_dir), "[Ll]icense").withColumnRenamed("path", "doc_id")


QUERIES = {q.__name__: q for q in (rule_scan_division, rule_scan_matched_files, rule_scan_scanned_files, bad_patterns, hinted_scan, hinted_files, line_positions)}
_NAMED_SQL = "n AS (SELECT 'Q' || quality AS rule_id, doc_id, text FROM labels JOIN documents USING (doc_id)), o AS (SELECT rule_id FROM n GROUP BY rule_id HAVING bool_or(regexp_matches(text, '[a-z]')) AND bool_or(regexp_matches(text, '[|] [a-z]+')))"
ORACLES = {
    "rule_scan_division": f"WITH {_RULES_SQL}, {_HITS_SQL}, {_FOUND_SQL} SELECT rule_id, n_patterns FROM found",
    "rule_scan_matched_files": f"WITH {_RULES_SQL}, {_HITS_SQL}, {_FOUND_SQL} SELECT DISTINCT rule_id, doc_id FROM hits WHERE rule_id IN (SELECT rule_id FROM found)",
    "rule_scan_scanned_files": f"WITH {_RULES_SQL}, {_HITS_SQL}, {_FOUND_SQL} SELECT rule_id, doc_id, EXISTS (SELECT 1 FROM hits h WHERE h.rule_id = found.rule_id AND h.doc_id = documents.doc_id) AS matched FROM found, documents",
    "bad_patterns": f"WITH {_RULES_SQL}, {_HITS_SQL}, {_FOUND_SQL} SELECT rule_id, 'found' AS state FROM found UNION ALL SELECT rule_id, 'skipped' FROM (VALUES ('R-OTHER'), ('R-BROKEN')) t(rule_id)",
    "hinted_scan": f"WITH {_NAMED_SQL} SELECT DISTINCT rule_id, doc_id FROM n WHERE rule_id IN (SELECT rule_id FROM o) AND (regexp_matches(text, '[a-z]') OR regexp_matches(text, '[|] [a-z]+'))",
    "hinted_files": f"WITH {_NAMED_SQL} SELECT DISTINCT rule_id, doc_id FROM n",
    "line_positions": "SELECT doc_id, CAST(pos AS INTEGER) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) t WHERE regexp_matches(line, '[Ll]icense')",
}
