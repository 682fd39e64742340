"""Which rules to run: predicates over a rule pack before anything is scanned (FLT1-6, FLT8, JN6-7, SET2).

rules: rule_id, grp ('assigned' or 'disputed'), files array<string>, min_version string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = ("all", "assigned", "disputed")
_ID = re.compile(r"CVE-\d{4}-\d{4,7}")


def normalise_id(value: str) -> str:
    """An id with its prefix; ValueError if it isn't one."""
    out = value if value.startswith("CVE-") else f"CVE-{value}"
    if not _ID.fullmatch(out):
        raise ValueError(f"not a CVE id: {value!r}")
    return out


def by_group(rules: DataFrame, group: str) -> DataFrame:
    return rules if group == "all" else rules.where(F.col("grp") == group)


def by_ids(rules: DataFrame, ids: list[str]) -> DataFrame:
    """The rules named; an id that no rule has is an error."""
    wanted = rules.sparkSession.createDataFrame([(normalise_id(i),) for i in ids], "rule_id string")
    if unknown := [r.rule_id for r in wanted.join(rules, "rule_id", "left_anti").collect()]:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return rules.join(F.broadcast(wanted), "rule_id", "left_semi")  # as many rows as ids were typed


def choose(rules: DataFrame, names: list[str]) -> DataFrame:
    """A group word alone is a group; anything else is a list of ids."""
    return by_group(rules, names[0]) if len(names) == 1 and names[0] in GROUPS else by_ids(rules, names)


def excluding(rules: DataFrame, ids: list[str]) -> DataFrame:
    """Without the ids, which needn't be known rules."""
    if not ids:
        return rules
    return rules.join(rules.sparkSession.createDataFrame([(normalise_id(i),) for i in ids], "rule_id string"), "rule_id", "left_anti")


def without(rules: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without the rules of a table of ids."""
    return rules.join(excluded.select("rule_id").distinct(), "rule_id", "left_anti")


def exploited(rules: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rules whose record says so; no record or no flag is a no."""
    return rules.join(metadata.where(F.coalesce("exploit", F.lit(False))).select("rule_id"), "rule_id", "left_semi")


def _starts(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def by_files(rules: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rules any of whose hinted paths starts with any prefix; path boundaries don't count."""
    return rules.where(F.exists("files", lambda f: _starts(f, prefixes)))


def ignoring_files(rules: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rules with a hinted path that is no header and starts with no prefix; so rules of headers alone go."""
    return rules.where(F.exists(F.filter("files", lambda f: ~f.endswith(".h")), lambda f: ~_starts(f, prefixes)))


def version_array(value: Column) -> Column:
    """A dotted version as integers, compared member by member, so that 1.10 comes after 1.9."""
    return F.transform(F.split(value, r"\."), lambda x: x.cast("int"))


def supported(rules: DataFrame, engine: str) -> DataFrame:
    """Rules whose minimum version, if any, the engine has."""
    return rules.where(F.coalesce(version_array(F.col("min_version")) <= version_array(F.lit(engine)), F.lit(True)))


def unsupported(rules: DataFrame, engine: str) -> DataFrame:
    return rules.where(version_array(F.col("min_version")) > version_array(F.lit(engine)))


_PATH = re.compile(r"[_a-zA-Z-./0-9]+")


def check_paths(paths: list[str]) -> None:
    """ValueError for what is no path to choose rules by."""
    for p in paths:
        if not _PATH.fullmatch(p):
            raise ValueError(f"not a path: {p!r}")
