"""One audit of one source tree, for programs: rules, metadata, configuration, and results as plain dicts (PRJ1, P1)."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions.makefile import srcarch
from treelens.operators import regex_match, select, structural, verdict
from treelens.plans import buildmap, report
from treelens.sources import tree as sources

ENGINE_VERSION = "1.1.2"


class Audit:
    """A tree, a pack of rules, and perhaps metadata and a configuration; ``config`` "-" maps files to conditions without judging them."""

    def __init__(self, spark: SparkSession, kernel: str, rules: str, metadata: str | None = None, config: str | None = None, check_strict: bool = False, arch: str = "x86"):
        self.spark, self.kernel, self.check_strict, self.arch = spark, kernel.rstrip("/"), check_strict, arch
        self.rules = sources.rules(spark, rules).cache()
        empty = spark.createDataFrame([], "rule_id string, fixes string, breaks string, fix_date long, cmt_msg string, rejected boolean, exploit boolean")
        self.metadata = sources.metadata(spark, metadata) if metadata else empty
        self.config_file = config if config and config != "-" else None
        self.config = {r.symbol: r.enabled for r in sources.config(spark, self.config_file).collect()} if self.config_file else None
        self._mapped = bool(config)

    # What the pack says.

    def ids(self, group: str = "all") -> set[str]:
        return {r.rule_id for r in select.by_group(self.rules, group).select("rule_id").collect()}

    def rule(self, rule_id: str):
        """The rule's row: path, kind, grp, body, files, fix, fixes, min_version; KeyError if there is none."""
        if row := self.rules.where(F.col("rule_id") == rule_id).first():
            return row
        raise KeyError(rule_id)

    def rule_files(self, rule_id: str) -> list[str]:
        return list(self.rule(rule_id).files)

    def rule_fix(self, rule_id: str) -> str | None:
        return self.rule(rule_id).fix

    def rule_fixes(self, rule_id: str) -> str | None:
        return self.rule(rule_id).fixes

    def rule_version(self, rule_id: str) -> str | None:
        return self.rule(rule_id).min_version

    def metadata_of(self, rule_id: str) -> dict:
        row = self.metadata.where(F.col("rule_id") == rule_id).first()
        return {k: v for k, v in row.asDict().items() if v is not None and k != "rule_id"} if row else {}

    def exploit(self, rule_id: str) -> bool:
        return self.metadata_of(rule_id).get("exploit", False)

    # What the tree says.

    def build_map(self) -> DataFrame:
        names = sources.files(self.spark, self.kernel)
        return buildmap.build_map(names, self.arch).select("path", "condition")

    def skipped(self, rules: DataFrame) -> DataFrame:
        """(rule_id, reason) of the rules that can't be held against anything here."""
        old = select.unsupported(rules.where("kind = 'cocci'"), ENGINE_VERSION).select("rule_id", F.concat(F.lit("requires version "), "min_version").alias("reason"))
        unread = structural.judged(rules.where("kind = 'cocci'")).where("reason is not null").select("rule_id", "reason")
        return old.unionByName(unread).unionByName(regex_match.skipped(sources.patterns(rules)).select("rule_id", "reason"))

    def scan(self, rule_ids: list[str] | None = None, all_files: bool = False) -> dict[str, dict]:
        """The result of each rule that was found: its metadata, files, and with a configuration the files' conditions and verdicts."""
        rules = self.rules if rule_ids is None else self.rules.join(self.spark.createDataFrame([(i,) for i in rule_ids], "rule_id string"), "rule_id", "left_semi")
        rules = select.supported(rules, ENGINE_VERSION)
        hints = sources.hints(rules)
        files = sources.files(self.spark, self.kernel, only=None if all_files else [r.path for r in hints.select("path").distinct().collect()])
        patterns = sources.patterns(rules)
        grep = report.findings(rules.where("kind = 'grep'"), patterns, files, all_files)
        scanned = regex_match.scanned_files(files, patterns, None if all_files else hints)
        lines = structural.scan(files, rules.where("kind = 'cocci'"), all_files).select("rule_id", "path", "line")
        tagged = report.with_scanned(grep, scanned).select("rule_id", "path", F.lit(None).cast("int").alias("line"), "matched").unionByName(lines.withColumn("matched", F.lit(True))).collect()
        verdicts: dict[str, list] = defaultdict(list)
        if self._mapped and tagged:
            found = self.spark.createDataFrame(sorted({(r.rule_id, r.path) for r in tagged if r.matched}), "rule_id string, path string")
            for r in verdict.file_verdicts(found, self.build_map(), srcarch(self.arch), self.config).collect():
                verdicts[r.rule_id].append(r)
        out: dict[str, dict] = {}
        known = {r.rule_id: {k: v for k, v in r.asDict().items() if v is not None and k != "rule_id"} for r in self.metadata.join(self.spark.createDataFrame([(i,) for i in {r.rule_id for r in tagged}], "rule_id string"), "rule_id", "left_semi").collect()}
        for rule_id in sorted({r.rule_id for r in tagged}):
            rows = sorted((r for r in tagged if r.rule_id == rule_id), key=lambda r: (r.path, r.line or 0))
            judged: dict = {}
            if verdicts[rule_id]:
                judged["files"] = {v.path: {"logic": v.logic, "mapped": v.mapped} | ({} if v.affected is None else {"config": v.affected}) for v in sorted(verdicts[rule_id], key=lambda v: v.path)}
                if told := [v.affected for v in verdicts[rule_id] if v.affected is not None]:
                    judged["affected"] = any(told)
            if self.check_strict and judged.get("affected") is False:
                continue
            files_of = [{"file": r.path} | ({"line": r.line} if r.line is not None else {}) for r in rows]
            out[rule_id] = known.get(rule_id, {}) | {"config": judged, "files": files_of, "matched": sorted({r.path for r in rows if r.matched})}
        return out

    def check(self, rule_id: str, all_files: bool = False) -> dict | None:
        """One rule's result, None if it isn't found; KeyError if there is no such rule."""
        self.rule(rule_id)
        return self.scan([rule_id], all_files).get(rule_id)
