"""Readers: source trees, rule packs, configurations, metadata, advisories (SRC1-7, SRC11-14).

Each reader of a kind of file comes as a function of rows (path, content), of any number of such files at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.tables import exists, read_text

METADATA = "map<string,struct<fixes:string,breaks:string,fix_date:bigint,cmt_msg:string,rejected:boolean,exploit:boolean>>"
_CNA = "struct<affected:array<struct<versions:array<struct<versionType:string,status:string,version:string,lessThan:string>>>>>"
EXPLOITED = "struct<vulnerabilities:array<struct<cveID:string>>>"
ISSUE = "cve string, fixed_by array<string>, introduced_by array<string>, note string"
_ID = r"^CVE-\d{4}-\d{4,7}$"


def _name() -> Column:
    """A file's path as it is written, not percent-encoded."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _relative(root: str) -> Column:
    base = "/" + root.strip("/").split("://")[-1].strip("/")
    escaped = "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in base)
    return F.regexp_replace(_name(), f"^.*?{escaped}/", "")


def files(spark: SparkSession, root: str, tree: str = "", only: list[str] | None = None) -> DataFrame:
    """(tree, path, content) of every file under root, or of those named that are there, a row a file; bytes that aren't UTF-8 are replaced."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if only is not None:
        there = [p for p in (f"{root.rstrip('/')}/{name}" for name in sorted(set(only))) if exists(spark, p)]
        if not there:
            return spark.createDataFrame([], "tree string, path string, content string")
    raw = reader.load(root if only is None else there)
    return raw.select(F.lit(tree).alias("tree"), _relative(root).alias("path"), F.decode("content", "UTF-8").alias("content"))


def rules(spark: SparkSession, root: str) -> DataFrame:
    """rule_id, kind, grp, path, body and header columns of a rule pack: every file is a rule."""
    return rules_of(files(spark, root).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "path")))


def rules_of(files: DataFrame) -> DataFrame:
    name, folder = F.regexp_extract("path", "([^/]+)$", 1), F.regexp_extract("path", "^(.*)/", 1)
    out = files.select(
        F.regexp_replace(F.regexp_replace(name, r"\.grep$", ""), r"\.cocci$", "").alias("rule_id"),
        F.when(name.endswith(".grep"), "grep").otherwise("cocci").alias("kind"),
        F.when(folder.contains("disputed"), "disputed").otherwise("assigned").alias("grp"),
        "path",
        F.col("content").alias("body"),
    )
    return with_header(out)


def with_header(rules_: DataFrame) -> DataFrame:
    """Add files, fix, fixes, min_version from the first block of /// lines; a repeated tag's last one holds."""
    block = F.regexp_extract("body", r"^((?:///[^\n]*(?:\n|$))*)", 1)

    def tag(pattern: str) -> Column:
        return F.nullif(F.trim(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(block, F.lit(rf"(?m)^///.*?(?:{pattern}):[ \t]*([^\n]*)$"))), -1)), F.lit(""))

    hinted = F.array_remove(F.split(F.coalesce(tag("Files"), F.lit("")), r"\s+"), "")
    return rules_.withColumns({"files": hinted, "fix": tag("Fix"), "fixes": tag("Fixes|Detect-To"), "min_version": tag("Version")})


def hints(rules_: DataFrame) -> DataFrame:
    """(rule_id, path) of the files that rules name."""
    return rules_.select("rule_id", F.explode("files").alias("path"))


def patterns(rules_: DataFrame) -> DataFrame:
    """(rule_id, pat_id, pattern): the lines of grep rules that are neither blank nor comments."""
    lines = rules_.where("kind = 'grep'").select("rule_id", F.posexplode(F.split("body", "\n")).alias("pat_id", "line"))
    return lines.select("rule_id", "pat_id", F.trim("line").alias("pattern")).where("pattern <> '' and not startswith(pattern, '//')")


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(path, read_text(spark, path))], "path string, content string")


def config(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, enabled) of one configuration."""
    return config_of(_text(spark, path)).drop("path")


def config_of(files: DataFrame) -> DataFrame:
    """(path, symbol, enabled): CONFIG_X=anything is on, '# CONFIG_X is not set' off; the last line of a symbol holds."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    on, off = F.regexp_extract("line", r"^\s*(CONFIG_[^=]*)", 1), F.regexp_extract("line", r"^\s*# (CONFIG_\S*) (?:.* )?is not set\s*$", 1)
    known = lines.select("path", "at", F.coalesce(F.nullif(F.trim(on), F.lit("")), F.nullif(off, F.lit(""))).alias("symbol"), (on != "").alias("enabled")).where("symbol is not null")
    return known.groupBy("path", "symbol").agg(F.max_by("enabled", "at").alias("enabled"))


def config_banner(spark: SparkSession, path: str) -> DataFrame:
    """(arch, version) of one configuration's first banner line; no row if there is none."""
    return banner_of(_text(spark, path)).drop("path")


def banner_of(files: DataFrame) -> DataFrame:
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    banner = r"^# Linux/(\S+)\s+(\S+)\s+Kernel Configuration"
    hit = lines.where(F.col("line").rlike(banner)).groupBy("path").agg(F.min_by("line", "at").alias("line"))
    return hit.select("path", F.regexp_extract("line", banner, 1).alias("arch"), F.regexp_extract("line", banner, 2).alias("version"))


def kernel_version(makefile: Column) -> Column:
    """version, patchlevel, sublevel, extraversion, name, full of a top makefile's text."""
    get = lambda key: F.regexp_extract(makefile, rf"(?m)^{key}[ \t]*=[ \t]*(.*?)[ \t]*$", 1)
    parts = [get(k) for k in ("VERSION", "PATCHLEVEL", "SUBLEVEL", "EXTRAVERSION", "NAME")]
    full = F.concat(F.concat_ws(".", *parts[:3]), parts[3])
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("version", "patchlevel", "sublevel", "extraversion", "name"), strict=True)], full.alias("full"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a CVE of a (gzipped) JSON map."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", METADATA)).alias("rule_id", "m"))
    return rows.select("rule_id", "m.*")


def exclude_list(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id) of a list, which may leave out the ids' prefix; ValueError if a line is no id."""
    listed = exclude_list_of(_text(spark, path))
    if wrong := listed.where("not valid").first():
        raise ValueError(f"not a CVE id: {wrong.rule_id!r} in {path}")
    return listed.select("rule_id")


def exclude_list_of(files: DataFrame) -> DataFrame:
    """(path, rule_id, valid) of each line that is neither blank nor a comment."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line")).select("path", F.trim("line").alias("v")).where("v <> '' and not startswith(v, '#')")
    return lines.select("path", F.when(F.col("v").startswith("CVE-"), F.col("v")).otherwise(F.concat(F.lit("CVE-"), "v")).alias("rule_id")).withColumn("valid", F.col("rule_id").rlike(_ID))


def advisories(spark: SparkSession, root: str) -> DataFrame:
    """cve, affected, rejected of CVE JSON 5 records under published/ and rejected/."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="CVE-*.json")
    return advisories_of(raw.select(_name().alias("path"), F.col("value").alias("content")))


def advisories_of(files: DataFrame) -> DataFrame:
    """Files that can't be read are left out; of the spellings of the id's field, which differ in case alone, the first that is there counts, or else the file's name."""
    read = lambda path: F.nullif(F.get_json_object("content", path), F.lit(""))
    named = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    cve = F.coalesce(read("$.cveMetadata.cveId"), read("$.cveMetadata.cveID"), named)
    rows = files.select(cve.alias("cve"), F.from_json(F.get_json_object("content", "$.containers.cna"), _CNA).alias("cna"), F.col("path").contains("rejected/").alias("rejected"), F.get_json_object("content", "$").alias("whole"))
    return rows.where("whole is not null and startswith(cve, 'CVE-')").select("cve", F.col("cna.affected").alias("affected"), "rejected")


def issues(spark: SparkSession, root: str) -> DataFrame:
    """cve, fixed_by, introduced_by, note of the YAML issues CVE-*.yml of a folder."""
    raw = spark.read.text(root, wholetext=True, pathGlobFilter="CVE-*.yml")
    return issues_of(raw.select(_name().alias("path"), F.col("value").alias("content")))


def issues_of(files: DataFrame) -> DataFrame:
    """The mainline's commits of each issue, a single one as a list of one, and the note under ignore: all; empty or unreadable files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same, eight times as fast where libyaml is there

        def listed(data: dict, key: str) -> list[str]:
            side = data.get(key)
            value = side.get("mainline") if isinstance(side, dict) else None
            return [str(x) for x in ([value] if isinstance(value, str) else value or [])]

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    data = yaml.load(content or "", loader)
                except yaml.YAMLError:
                    continue
                if isinstance(data, dict) and data:
                    note = (data.get("ignore") or {}).get("all") if isinstance(data.get("ignore"), dict) else None
                    rows.append((path.rsplit("/", 1)[-1].removesuffix(".yml"), listed(data, "fixed-by"), listed(data, "introduced-by"), note if isinstance(note, str) else None))
            yield pd.DataFrame(rows, columns=["cve", "fixed_by", "introduced_by", "note"])

    return files.select("path", "content").mapInPandas(run, ISSUE)


def exploited(spark: SparkSession, path: str) -> DataFrame:
    return exploited_of(_text(spark, path))


def exploited_of(files: DataFrame) -> DataFrame:
    """(cve) of catalogues of exploited vulnerabilities, each once."""
    return files.select(F.explode(F.from_json("content", EXPLOITED)["vulnerabilities"]["cveID"]).alias("cve")).where("cve <> ''").distinct()


def history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """commits and parents of an exported history (see history_of)."""
    return history_of(spark.read.text(path))


def history_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commits (sha, committed_at, subject) and parents (sha, parent, nth) of lines (value) ``sha<TAB>parents<TAB>seconds<TAB>subject``.

    ``git log --all --format=%H%x09%P%x09%ct%x09%s`` writes them (SRC15).
    """
    part = F.split("value", "\t", 4)
    rows = lines.where(F.col("value").rlike(r"^[0-9a-f]{40}\t")).select(F.get(part, 0).alias("sha"), F.array_remove(F.split(F.get(part, 1), " "), "").alias("parents"), F.get(part, 2).cast("long").alias("committed_at"), F.get(part, 3).alias("subject"))
    return rows.select("sha", "committed_at", "subject"), rows.select("sha", F.posexplode("parents").alias("nth", "parent")).select("sha", "parent", "nth")


def topological_order(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """commits with ``depth``, the longest way down to a root: sorted by it from high to low, no parent stands before a child (SRT5).

    A round a level, for the short histories of tests and releases.
    """
    from treelens.tables import cut, discard

    depth = cut(commits.select("sha").withColumn("depth", F.lit(0)))
    while True:
        below = parents.join(depth.select(F.col("sha").alias("parent"), F.col("depth").alias("d")), "parent").groupBy("sha").agg((F.max("d") + 1).alias("d"))
        more = cut(depth.join(below, "sha", "left").select("sha", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved")))
        done = more.where("moved").isEmpty()
        discard(depth)
        depth = more
        if done:
            return commits.join(depth.select("sha", "depth"), "sha")
