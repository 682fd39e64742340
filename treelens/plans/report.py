"""A scan end to end, and its outputs (P1, P3, RGX4, SNK1-5, SRT1-3)."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.operators import regex_match, verdict
from treelens.tables import write_text


def findings(rules: DataFrame, patterns: DataFrame, files: DataFrame, all_files: bool = False) -> DataFrame:
    """(rule_id, path) of the files matched by the found rules; hinted files alone unless all_files."""
    hints = None if all_files else rules.select("rule_id", F.explode("files").alias("path"))
    hits = regex_match.pattern_hits(files, patterns, hints)
    return regex_match.matched_files(hits, regex_match.division(hits, patterns))


def with_scanned(found: DataFrame, scanned: DataFrame) -> DataFrame:
    """(rule_id, path, matched) of all files that the found rules were held against."""
    kept = scanned.join(found.select("rule_id").distinct(), "rule_id", "left_semi")
    return kept.join(found.withColumn("matched", F.lit(True)), ["rule_id", "path"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def results(found: DataFrame, metadata: DataFrame, verdicts: DataFrame | None = None, check_strict: bool = False) -> DataFrame:
    """One row a rule: its metadata, matched files, and with verdicts whether any file is affected."""
    per = found.groupBy("rule_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    if verdicts is not None:
        per = per.join(verdict.any_affected(verdicts), "rule_id", "left")
        per = verdict.strict(per) if check_strict else per
    return per.join(metadata, "rule_id", "left").orderBy("rule_id")


def message(row: DataFrame) -> DataFrame:
    """The console's lines for each rule found."""
    date = F.date_format(F.timestamp_seconds("fix_date"), "yyyy-MM-dd")
    return row.select("rule_id", F.concat_ws("\n", F.concat(F.lit("Found: "), "rule_id"), F.concat(F.lit("MSG: "), "cmt_msg"), F.concat(F.lit("FIX DATE: "), date), F.concat(F.lit("https://www.cve.org/CVERecord?id="), "rule_id")).alias("text"))


def verdict_message(verdicts: DataFrame, config: str | None) -> DataFrame:
    """The console's lines on each rule's files (rule_id, path, logic, affected), and on the rule, which is any of its files."""
    said = lambda x: F.when(x, "affected").otherwise("not affected")
    line = F.concat(F.lit(" - "), "path", F.lit(": "), "logic")
    if config is not None:
        line = F.concat_ws("\n", line, F.concat(F.lit(f"   {config}: "), said(F.col("affected"))).alias("x"))
    per = verdicts.withColumn("line", line).groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.bool_or("affected").alias("affected"))
    last = F.concat(F.lit("Config: " + (f"{config} " if config is not None else "any ")), said(F.col("affected")))
    return per.select("rule_id", F.concat_ws("\n", F.lit("Affected Files:"), "lines", F.when(F.col("affected").isNotNull(), last)).alias("text"))


def listed(rules: DataFrame) -> DataFrame:
    """The ids of all rules in lexical order."""
    return rules.select("rule_id").distinct().orderBy("rule_id")


def report_json(rows: DataFrame) -> DataFrame:
    """(rule_id, json): one JSON object a rule, keys in order."""
    return rows.select("rule_id", F.to_json(F.struct(*sorted(c for c in rows.columns if c != "rule_id"))).alias("json"))


def write_results(rows: DataFrame, path: str) -> None:
    """A directory of JSON lines in the order of rule ids."""
    report_json(rows).orderBy("rule_id").select("json").write.text(path)


def document(args: Mapping, kernel: Mapping, config: Mapping, tools: Mapping, found: Mapping[str, Mapping]) -> str:
    """The whole report as one JSON text, keys in order: what was asked for, what was scanned, with what, and the result of each rule."""
    return json.dumps({"args": args, "kernel": kernel, "config": config, "tools": tools, "results": found}, indent=4, sort_keys=True)


def write_document(spark: SparkSession, path: str, text: str) -> None:
    write_text(spark, path, text)


def metadata_json(rows: DataFrame) -> DataFrame:
    """(value): the metadata as one JSON map by CVE, which the pack of rules bounds."""
    fields = F.struct(*[c for c in rows.columns if c != "rule_id"])
    return rows.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", fields))))).alias("value"))


def write_metadata(rows: DataFrame, path: str) -> None:
    """The metadata as one gzipped JSON map by CVE."""
    metadata_json(rows).write.option("compression", "gzip").text(path)
