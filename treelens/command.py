"""The command line: which rules, which tree, what to write (SNK1, SNK3-5, KB3, PRJ4, SRT1-2)."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

import pyspark
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import treelens
from treelens.api import ENGINE_VERSION, Audit
from treelens.functions.makefile import resolve_arch
from treelens.operators import select
from treelens.plans import report
from treelens.session import local_session
from treelens.sources import options
from treelens.sources import tree as sources
from treelens.tables import exists


class Refused(Exception):
    """Something asked for that can't be done: told to the user, who gets exit code 1."""


def versions() -> dict[str, str]:
    """What did the scan (SRC18)."""
    return {"treelens": treelens.__version__, "rules": ENGINE_VERSION, "pyspark": pyspark.__version__}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="treelens", description="Look for known vulnerabilities in a source tree.", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    out.add_argument("--rules", metavar="DIR", default=os.environ.get("TREELENS_RULES"), help="pack of rules")
    out.add_argument("--config", metavar="FILE", help="options file; else /etc/treelens.ini and $HOME/.config/treelens.ini")
    out.add_argument("--kernel", "-k", metavar="DIR", help="source tree")
    out.add_argument("--list", action="store_true", help="list all rules and exit")
    out.add_argument("--cve", "-c", nargs="+", default=["assigned"], help="ids, or a group: all, assigned, disputed")
    out.add_argument("--exclude", "-x", nargs="+", default=[], metavar="CVE", help="ids, or files of them, to leave out")
    out.add_argument("--verbose", "-v", action="count", default=0)
    out.add_argument("--exploit", "-e", action="store_true", help="only what is known to be exploited")
    out.add_argument("--files", nargs="+", default=[], metavar="PATH", help="only rules on these files")
    out.add_argument("--ignore-files", nargs="+", default=[], metavar="PATH", help="no rules on these files alone")
    out.add_argument("--kernel-config", nargs="?", const="-", metavar=".config", help="judge files by a configuration; without a name, the tree's own")
    out.add_argument("--arch", help="architecture; else as the configuration's banner says, else x86")
    out.add_argument("--check-strict", action="store_true", help="leave out what the configuration rules out")
    out.add_argument("--report", nargs="?", const="report.json", metavar="FILE", help="write a report")
    out.add_argument("--all-files", action="store_true", help="scan all files, not only those that rules name")
    out.add_argument("--metadata", metavar="FILE", default=os.environ.get("TREELENS_METADATA"), help="gzipped metadata")
    out.add_argument("--version", action="version", version=treelens.__version__)
    return out


def _at_hand(path: str) -> None:
    """Neither trees nor rules nor metadata are cloned or downloaded (SRC16-17)."""
    if path.split("://")[0] in ("http", "https", "git", "ssh"):
        raise Refused(f"{path} isn't fetched: get a copy and name its folder")


def _options(spark: SparkSession, args: argparse.Namespace, defaults: dict) -> dict:
    """The options of the command line and of the files, checked (FLT7, KB3's needs, SET2)."""
    places = [args.config] if args.config else ["/etc/treelens.ini", *([str(Path(os.environ["HOME"]) / ".config/treelens.ini")] if "HOME" in os.environ else [])]
    if args.config and not os.path.isfile(args.config):
        raise Refused(f"no options file {args.config}")
    given = {k: v for k, v in vars(args).items() if k not in ("config", "list", "rules")}
    out = options.merged(options.layers(*[Path(p).read_text() for p in places if os.path.isfile(p)]), given, defaults)
    if not out["kernel"]:
        raise Refused("which tree? --kernel is required")
    _at_hand(out["kernel"])
    if out["metadata"] and (not exists(spark, out["metadata"]) or not out["metadata"].endswith(".gz")):
        raise Refused(f"{out['metadata']} is no gzipped metadata")
    if not exists(spark, f"{out['kernel']}/Makefile"):
        raise Refused(f"{out['kernel']} isn't a source tree")
    if out["kernel_config"] == "-":
        own = f"{str(out['kernel']).rstrip('/')}/.config"
        if exists(spark, own):
            out["kernel_config"] = own
        elif out["check_strict"]:
            raise Refused(f"--check-strict needs a configuration, and there is no {own}")
        else:
            print(f"no {own}: conditions are told, but not judged", file=sys.stderr)
    elif out["kernel_config"] and not exists(spark, out["kernel_config"]):
        raise Refused(f"no configuration {out['kernel_config']}")
    if out["check_strict"] and not out["kernel_config"]:
        raise Refused("--check-strict needs --kernel-config")
    out["verbose"] = max(out["verbose"], bool(out["kernel_config"]))
    options.check(out)
    select.check_paths([*out["files"], *out["ignore_files"]])
    return out


def chosen(audit: Audit, opts: dict) -> list[str]:
    """The ids of the rules to run, in lexical order (FLT1-6)."""
    rules = select.choose(audit.rules, opts["cve"])
    for name in opts["exclude"]:
        if exists(audit.spark, name):
            rules = select.without(rules, sources.exclude_list(audit.spark, name))
    rules = select.excluding(rules, [x for x in opts["exclude"] if not exists(audit.spark, x)])
    if opts["exploit"]:
        rules = select.exploited(rules, audit.metadata)
    if opts["files"]:
        rules = select.by_files(rules, opts["files"])
    if opts["ignore_files"]:
        rules = select.ignoring_files(rules, opts["ignore_files"])
    return [r.rule_id for r in report.listed(rules).collect()]


def _say(audit: Audit, found: dict[str, dict], verbose: int) -> None:
    spark = audit.spark
    if not found:
        return
    rows = spark.createDataFrame([(i,) for i in found], "rule_id string").join(audit.metadata, "rule_id", "left")
    texts = {r.rule_id: r.text for r in report.message(rows).collect()}
    told = [(i, path, v["logic"], v.get("config")) for i, result in found.items() for path, v in result["config"].get("files", {}).items()]
    verdicts = {r.rule_id: r.text for r in report.verdict_message(spark.createDataFrame(told, "rule_id string, path string, logic string, affected boolean"), audit.config_file).collect()} if told else {}
    for i in sorted(found):
        lines = texts[i].split("\n")
        print("\n".join([*(lines if verbose else lines[:1]), *([verdicts[i]] if verbose and i in verdicts else []), *([""] if verbose else [])]))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Findings don't change the exit code; what can't be done does."""
    reader = parser()
    args = reader.parse_args(argv)
    try:
        if not args.rules:
            raise Refused("which rules? name a pack by --rules or TREELENS_RULES")
        _at_hand(args.rules)
        spark = spark or local_session()
        if not exists(spark, args.rules, folder=True):
            raise Refused(f"no rules in {args.rules}")
        if args.list:
            print("\n".join(r.rule_id for r in report.listed(sources.rules(spark, args.rules)).collect()))
            return 0
        opts = _options(spark, args, {a.dest: a.default for a in reader._actions})
        config = opts["kernel_config"] if opts["kernel_config"] != "-" else None
        banner = sources.config_banner(spark, config).first() if config else None
        arch, warnings = resolve_arch(opts["arch"], banner and banner.arch, lambda d: exists(spark, f"{opts['kernel']}/{d}", folder=True), opts["check_strict"], config)
        for warning in warnings:
            print(warning, file=sys.stderr)
        audit = Audit(spark, opts["kernel"], args.rules, opts["metadata"], opts["kernel_config"], opts["check_strict"], arch)
        ids = chosen(audit, opts)
        rules = audit.rules.where(F.col("rule_id").isin(ids)) if ids else audit.rules.limit(0)
        for r in audit.skipped(rules).orderBy("rule_id").collect():
            print(f"skipping {r.rule_id}: {r.reason}", file=sys.stderr)
        found = audit.scan(ids, opts["all_files"]) if ids else {}
        _say(audit, found, opts["verbose"])
        if opts["report"]:
            kernel = sources.files(spark, opts["kernel"], only=["Makefile"]).select(sources.kernel_version(F.col("content")).alias("v")).first().v.asDict()
            asked = {"cve": ids, "kernel": opts["kernel"], "config": opts["kernel_config"], "only_files": sorted(opts["files"]), "all_files": opts["all_files"], "check_strict": opts["check_strict"], "arch": arch}
            report.write_document(spark, opts["report"], report.document(asked, kernel, banner.asDict() if banner else {}, versions(), found))
            print(f"Report saved to: {opts['report']}")
    except (Refused, ValueError) as wrong:
        print(f"treelens: {wrong}", file=sys.stderr)
        return 1
    return 0
