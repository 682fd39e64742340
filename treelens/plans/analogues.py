"""Selection, readers, conditions, metadata and reports as queries over the driver's tables, each with its SQL twin.

Where an operator reads text of some format, the text is made from a table's columns, and the SQL says what must be read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelens.functions import condition
from treelens.operators import metadata, select, verdict
from treelens.plans import report
from treelens.plans.scan import table
from treelens.sources import options
from treelens.sources import tree as sources
from treelens.tables import scratch, write_text

# Selection of rules. Each part is a rule.

_ID_SQL = "printf('CVE-%04d-%07d', 2000 + p_size, p_partkey)"


def _rules(s: SparkSession, d: str) -> DataFrame:
    rule_id = F.format_string("CVE-%04d-%07d", F.col("p_size") + 2000, F.col("p_partkey"))
    version = F.when(F.col("p_size") % 4 > 0, F.concat_ws(".", F.lit("1"), (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 12).cast("string")))
    return table(s, d, "part").select(rule_id.alias("rule_id"), "p_partkey", F.when(F.col("p_brand").startswith("Brand#1"), "assigned").otherwise("disputed").alias("grp"), F.array("p_type", "p_brand").alias("files"), version.alias("min_version"))


def select_group(s, d):
    return select.choose(_rules(s, d), ["assigned"]).select("rule_id")


def select_ids(s, d):
    """Ids as they are typed, the first five, without their prefix."""
    typed = [r.rule_id.removeprefix("CVE-") for r in _rules(s, d).orderBy("rule_id").limit(5).collect()]
    return select.choose(_rules(s, d), typed).select("rule_id", "p_partkey")


def exclude_ids(s, d):
    often = table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return select.without(_rules(s, d), _rules(s, d).join(often, "p_partkey", "left_semi")).select("rule_id")


def exclude_lists(s, d):
    """A list of each customer's orders, some ids without their prefix, with comments, blank lines and lines that are no ids."""
    line = F.when(F.col("o_orderstatus") == "F", F.format_string("CVE-2020-%07d", "o_orderkey")).when(F.col("o_orderstatus") == "O", F.format_string("  2020-%07d", "o_orderkey")).otherwise(F.concat(F.lit("no id "), "o_orderkey"))
    lists = table(s, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.concat(F.lit("# list\n\n"), F.array_join(F.collect_list(line), "\n")).alias("content"))
    return sources.exclude_list_of(lists)


def exploit_only(s, d):
    """Documents as rules, labels as their records."""
    rules = table(s, d, "documents").select(F.col("doc_id").alias("rule_id"))
    return select.exploited(rules, table(s, d, "labels").select(F.col("doc_id").alias("rule_id"), F.nullif(F.col("toxic") == 1, F.lit(False)).alias("exploit")))


def prefix_any(s, d):
    return select.by_files(_rules(s, d), ["PROMO", "STANDARD", "Brand#2"]).select("rule_id")


def prefix_ignore(s, d):
    return select.ignoring_files(_rules(s, d), ["PROMO", "Brand#2"]).select("rule_id")


def version_gate(s, d):
    """Rules that version 1.1.2 can run, and those that it skips."""
    can = select.supported(_rules(s, d), "1.1.2").select("rule_id", F.lit(True).alias("runs"))
    return can.unionByName(select.unsupported(_rules(s, d), "1.1.2").select("rule_id", F.lit(False).alias("runs")))


def option_layers(s, d):
    """Two options files for each supplier, the second overriding."""
    sup = table(s, d, "supplier")
    first = sup.select(F.col("s_suppkey").cast("string").alias("path"), F.lit(1).alias("layer"), F.concat(F.lit("# mine\ncve = CVE-2020-0001 2020-0002\nverbose = "), "s_nationkey", F.lit("\nkernel = /src/a\nexploit = Yes\n")).alias("content"))
    second = sup.select(F.col("s_suppkey").cast("string").alias("path"), F.lit(2).alias("layer"), F.concat(F.lit("kernel = /src/"), "s_suppkey", F.lit("\nexploit = "), F.when(F.col("s_acctbal") > 0, "t").otherwise("0"), F.lit("\n")).alias("content"))
    return options.layered(second.unionByName(first))


# Readers.


def tree_paths(s, d):
    """A file for each nation, with a space and a sign in its name, written and read back."""
    root = scratch(s, "tree of files+")
    for r in table(s, d, "nation").select("n_name", "n_regionkey").collect():  # 25 at any scale
        write_text(s, f"{root}/a dir/r{r.n_regionkey}/{r.n_name}+1 %.c", f"int {r.n_name};\n")
    return sources.files(s, root, "t")


def rule_headers(s, d):
    """A rule file for each part: tags in its header, one of them twice, and one below the header that doesn't count."""
    tagged = F.concat(F.lit("/// Files: a/"), "p_brand", F.lit(".c\tb.h\n/// Fix: old\n/// Fix: f"), "p_partkey", F.when(F.col("p_size") % 2 == 0, "\n/// Fixes: ").otherwise("\n/// Detect-To: "), "p_size", F.lit("\n/// Version: 1.0."), "p_size", F.lit("\n\n/// Files: c.c\n"))
    path = F.concat(F.lit("/pack/"), F.when(F.col("p_size") % 3 == 0, "disputed/").otherwise(""), F.format_string("CVE-2020-%07d", "p_partkey"), F.when(F.col("p_size") % 5 == 0, ".grep").otherwise(".cocci"))
    rules = sources.rules_of(table(s, d, "part").select(path.alias("path"), tagged.alias("content")))
    return rules.select("rule_id", "kind", "grp", F.array_join("files", " ").alias("files"), "fix", "fixes", "min_version")


def pattern_lines(s, d):
    """The patterns of a grep rule for each part."""
    body = F.concat(F.lit("// of "), "p_name", F.lit("\n\n  "), "p_brand", F.lit("  \n\n"), "p_type", F.lit("\n// end\n"))
    return sources.patterns(table(s, d, "part").select(F.col("p_partkey").alias("rule_id"), F.lit("grep").alias("kind"), body.alias("body")))


def config_symbols(s, d):
    """A configuration for each customer, a line an order: the last line of a symbol holds."""
    symbol = F.concat(F.lit("CONFIG_P"), F.substring("o_orderpriority", 1, 1))
    line = F.when(F.col("o_orderstatus") == "F", F.concat(symbol, F.lit("=y"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("# "), symbol, F.lit(" is not set"))).otherwise(F.concat(symbol, F.lit("=m")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    return sources.config_of(table(s, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.concat(F.lit("#\n# Automatically\n"), F.array_join(lines, "\n")).alias("content")))


def config_banners(s, d):
    """The first of two banners, or none."""
    text = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("#\n# Linux/"), F.lower("c_mktsegment"), F.lit("  5."), "c_nationkey", F.lit(".0 Kernel Configuration\n# Linux/arm 1.0 Kernel Configuration\n"))).otherwise("# none\n")
    return sources.banner_of(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), text.alias("content")))


def kernel_versions(s, d):
    text = F.concat(F.lit("# SPDX\nVERSION = 5\nPATCHLEVEL = "), "c_nationkey", F.lit("\nSUBLEVEL =\t"), "c_custkey", F.lit("\nEXTRAVERSION ="), F.when(F.col("c_acctbal") > 0, " -rc1").otherwise(""), F.lit("\nNAME = A Name  \nVERSION = 6\n"))
    return table(s, d, "customer").select("c_custkey", sources.kernel_version(text).alias("v")).select("c_custkey", "v.*")


def _records(s, d) -> DataFrame:
    bal = F.col("s_acctbal")
    return table(s, d, "supplier").select(F.concat(F.lit("CVE-"), "s_suppkey").alias("rule_id"), F.sha1(F.col("s_name").cast("binary")).alias("fixes"), F.when(bal > 0, "b").alias("breaks"), F.col("s_suppkey").alias("fix_date"), F.col("s_name").alias("cmt_msg"), F.when(bal < 0, F.lit(True)).alias("rejected"), F.when(F.col("s_nationkey") < 9, F.lit(True)).alias("exploit"))


def metadata_round_trip(s, d):
    """Metadata written as one gzipped JSON map and read back."""
    path = scratch(s, "metadata")
    report.write_metadata(_records(s, d), path)
    return sources.metadata(s, path).drop("fixes")


def exploited_catalogue(s, d):
    """A catalogue a region, with repeats; each vulnerability once."""
    entry = F.struct(F.concat(F.lit("CVE-"), "n_nationkey").alias("cveID"))
    files = table(s, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.to_json(F.struct(F.concat(F.collect_list(entry), F.array(F.struct(F.lit("CVE-0").alias("cveID")), F.struct(F.lit("").alias("cveID")))).alias("vulnerabilities"))).alias("content"))
    return sources.exploited_of(files)


# Histories. A customer's orders are a line of commits, each the child of the one before; an order's id names its commit.


#: A shortened id of no commit. Any id of 7 digits starts some commit once a history has millions of them, and then it is known.
UNKNOWN_ID = "0" * 39


def _sha(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("string"), 256), 1, 40)


def _history(s, d) -> tuple[DataFrame, DataFrame]:
    before = F.lag("o_orderkey").over(_by_customer())
    lines = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", before.alias("before"))
    value = F.concat_ws("\t", _sha(F.col("o_orderkey")), F.when(F.col("before").isNull(), "").otherwise(_sha(F.col("before"))), F.floor("o_totalprice").cast("string"), F.concat(F.lit(" fix "), "o_orderpriority"))
    return sources.history_of(lines.select(value.alias("value")).unionByName(s.createDataFrame([("not a commit",)], "value string")))


def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


def history_lines(s, d):
    commits, parents = _history(s, d)
    return commits.join(parents, "sha", "left").select("sha", "committed_at", "subject", "parent")


def topological_order(s, d):
    """How far each commit is from the first of its line."""
    return sources.topological_order(*_history(s, d)).select("sha", "depth")


def commit_validate(s, d):
    value = F.lower(F.hex(F.col("o_orderkey") * 7919 + 268435456))
    return table(s, d, "orders").select("o_orderkey", metadata.commit_id(F.when(F.col("o_orderkey") % 5 == 0, F.lit("never")).otherwise(value)).alias("sha"))


def commit_resolve(s, d):
    """Whole, shortened, ambiguous and unknown ids, and placeholders."""
    length = F.when(F.col("o_orderkey") % 3 == 0, 40).when(F.col("o_orderkey") % 3 == 1, 12).otherwise(7)
    value = F.when(F.col("o_orderstatus") == "P", "never").otherwise(F.substring(_sha(F.col("o_orderkey")), F.lit(1), length))
    ids = table(s, d, "orders").select("o_orderkey", value.alias("sha")).unionByName(s.createDataFrame([(-1, UNKNOWN_ID), (-2, "0")], "o_orderkey long, sha string"))
    return metadata.resolve(ids, _history(s, d)[0]).select("o_orderkey", "full")


def mainline_commits(s, d):
    """All that the tip reaches, which is the last order of the first customer that has any, among references that aren't the mainline's."""
    commits, parents = _history(s, d)
    orders = table(s, d, "orders")
    ref = F.when(F.col("o_custkey") == orders.agg(F.min("o_custkey")).first()[0], "refs/heads/master").otherwise(F.concat(F.lit("refs/tags/"), "o_custkey"))
    tips = orders.groupBy(ref.alias("ref")).agg(F.max("o_orderkey").alias("k")).select("ref", _sha(F.col("k")).alias("sha"))
    tips = tips.unionByName(tips.where("ref <> 'refs/heads/master'").limit(1).select(F.lit("HEAD").alias("ref"), "sha"))
    return metadata.ancestors(metadata.mainline_tip(tips), parents)


def poset_extremum(s, d):
    """The latest urgent order of each customer; a pair of customers, whose lines don't meet, has none if both have urgent orders."""
    _, parents = _history(s, d)
    urgent = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c"), _sha(F.col("o_orderkey")).alias("sha"))
    pairs = urgent.select(F.concat(F.lit("pair "), F.floor(F.col("c") / 2)).alias("cve"), "sha")
    return metadata.extremum(urgent.select(F.concat(F.lit("one "), "c").alias("cve"), "sha").unionByName(pairs), parents, latest=True)


def _advisories(s, d) -> DataFrame:
    """A record a customer: a range from each urgent order's commit to that of the customer's last order, and others that don't count.

    Every third record spells its id's field the other way, every third has none; those of negative balance were rejected.
    """
    orders = table(s, d, "orders").withColumn("last", F.max("o_orderkey").over(_by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    row = F.struct(F.when(F.col("o_orderpriority") == "5-LOW", "semver").otherwise("git").alias("versionType"), F.when(F.col("o_orderpriority") == "2-HIGH", "unaffected").otherwise("affected").alias("status"), F.substring(_sha(F.col("o_orderkey")), 1, 12).alias("version"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "").otherwise(_sha(F.col("last"))).alias("lessThan"))
    name = F.format_string("CVE-2020-%07d", "o_custkey")
    per = orders.groupBy("o_custkey").agg(F.collect_list(row).alias("versions")).join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    spelled = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit('{"cveId":"'), name, F.lit('"}'))).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit('{"cveID":"'), name, F.lit('"}'))).otherwise("{}")
    content = F.concat(F.lit('{"cveMetadata":'), spelled, F.lit(',"containers":{"cna":'), F.to_json(F.struct(F.array(F.struct("versions")).alias("affected"))), F.lit("}}"))
    path = F.concat(F.lit("/x/cve/"), F.when(F.col("c_acctbal") < 0, "rejected").otherwise("published"), F.lit("/2020/"), name, F.lit(".json"))
    return sources.advisories_of(per.select(path.alias("path"), content.alias("content")).unionByName(s.createDataFrame([("/x/cve/published/CVE-1.json", "no JSON")], "path string, content string")))


def advisory_ranges(s, d):
    records = _advisories(s, d)
    return metadata.git_ranges(records).join(records.select("cve", "rejected"), "cve")


def cna_records(s, d):
    """Fix, introduction and rejection of each record; the history is all mainline."""
    return metadata.cna_records(_advisories(s, d), *_history(s, d))


def _issues(s, d) -> DataFrame:
    """A YAML issue a customer: fixed by its urgent orders, a list or a single one; introduced by the first two; with a note on some."""
    orders = table(s, d, "orders").withColumn("nth", F.row_number().over(_by_customer()))
    urgent, first = F.collect_list(F.when(F.col("o_orderpriority") == "1-URGENT", _sha(F.col("o_orderkey")))), F.collect_list(F.when(F.col("nth") <= 2, F.substring(_sha(F.col("o_orderkey")), 1, 12)))
    per = orders.groupBy("o_custkey").agg(urgent.alias("fixed"), first.alias("from")).join(table(s, d, "customer").selectExpr("c_custkey as o_custkey", "c_mktsegment"), "o_custkey")
    note = F.when(F.col("c_mktsegment") == "BUILDING", "Not a kernel bug: closed elsewhere").when(F.col("c_mktsegment") == "FURNITURE", "seems Bogus").when(F.col("c_mktsegment") == "MACHINERY", "Minor issue, not a bug")
    flat = lambda c: F.concat(F.lit("  mainline: ["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]\n"))
    fixed = F.when(F.size("fixed") == 0, "  mainline: never\n").when(F.size("fixed") == 1, F.concat(F.lit("  mainline: '"), F.element_at("fixed", 1), F.lit("'\n"))).otherwise(flat(F.col("fixed")))
    text = F.concat(F.lit("description: |-\n  some text\nfixed-by:\n"), fixed, F.lit("  stable: ['0000000']\nintroduced-by:\n"), flat(F.col("from")), F.when(note.isNull(), "").otherwise(F.concat(F.lit("ignore:\n  linux-4.4: other\n  all: '"), note, F.lit("'\n"))))
    path = F.concat(F.lit("/i/"), F.format_string("CVE-2020-%07d", "o_custkey"), F.lit(".yml"))
    return sources.issues_of(per.select(path.alias("path"), text.alias("content")).unionByName(s.createDataFrame([("/i/CVE-1.yml", "a: [b"), ("/i/CVE-2.yml", "")], "path string, content string")))


def cip_records(s, d):
    """Fix, introduction and rejection of each issue."""
    return metadata.cip_records(_issues(s, d), *_history(s, d))


def merged_records(s, d):
    """Both sources' records, the advisories overriding field by field."""
    commits, parents = _history(s, d)
    history = metadata.History(commits, parents)
    return metadata.merge_sources(metadata.cip_records(_issues(s, d), commits, parents, history=history), metadata.cna_records(_advisories(s, d), commits, parents, history=history))


def enriched_records(s, d):
    """The records of the advisories with their fixes' dates and subjects, and which of them are exploited."""
    commits, _ = _history(s, d)
    exploited = table(s, d, "customer").where("c_nationkey < 9").select(F.format_string("CVE-2020-%07d", "c_custkey").alias("cve"))
    return metadata.enrich(cna_records(s, d), commits, exploited.unionByName(exploited)).select("cve", "fix_date", "cmt_msg", "exploit", "rejected")


def source_counts(s, d):
    return metadata.source_counts(advisories=_advisories(s, d), issues=_issues(s, d))


def coalesce_merge(s, d):
    sup = table(s, d, "supplier")
    left = sup.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("cve"), F.col("s_name").alias("fixes"), F.lit(None).cast("string").alias("breaks"))
    right = sup.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("cve"), F.when(F.col("s_acctbal") > 0, F.lit("paid")).alias("fixes"), F.lit("r").alias("breaks"))
    return metadata.merge(left, right, ["fixes", "breaks"])


def drop_empty(s, d):
    rows = table(s, d, "labels").select("doc_id", "toxic", "quality", (F.col("toxic") == 1).alias("flag"), F.when(F.col("quality") == 1, "good").otherwise("").alias("word"))
    return metadata.drop_empty(rows, "doc_id")


def rejected_text(s, d):
    return table(s, d, "documents").select("doc_id", metadata.rejected(F.col("text"), ("The ", "Der "), ("License", "| ")).alias("rejected"))


# Conditions and verdicts.


def verdict_any(s, d):
    files = table(s, d, "nation").join(table(s, d, "supplier"), F.expr("n_nationkey = s_nationkey"), "left")
    return verdict.any_affected(files.select(F.col("n_name").alias("rule_id"), (F.col("s_acctbal") > 5000).alias("affected")))


def verdict_strict(s, d):
    """Without the rules that are known not to be affected."""
    return verdict.strict(verdict_any(s, d))


def _findings(s, d) -> tuple[DataFrame, DataFrame]:
    """Each customer a file of its segment's rule, of this architecture, another one or none, a source or a header, and what the build map says of it."""
    key, n = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    path = F.concat(F.when(n % 4 == 0, "arch/arm/").when(n % 4 == 1, "arch/x86/").otherwise("drivers/"), key, F.when(n % 5 == 0, ".h").when(n % 5 == 1, ".S").otherwise(".c"))
    logic = F.when(n % 6 == 0, F.lit(None)).when(n % 6 == 1, "").when(n % 6 == 2, "CONFIG_B & CONFIG_A").when(n % 6 == 3, "(CONFIG_C) | (CONFIG_A & CONFIG_C)").when(n % 6 == 4, "~CONFIG_MISSING & CONFIG_A").otherwise("CONFIG_A & (CONFIG_B | CONFIG_C)")
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("rule_id"), path.alias("path"), logic.alias("condition"))
    return rows.select("rule_id", "path"), rows.where("condition is not null").select("path", "condition")


CONFIG = {"CONFIG_A": True, "CONFIG_B": False, "CONFIG_C": True}


def file_verdicts(s, d):
    return verdict.file_verdicts(*_findings(s, d), "x86", CONFIG)


def file_conditions(s, d):
    """Without a configuration there are conditions but no verdicts."""
    return verdict.file_verdicts(*_findings(s, d), "x86", None).select("path", "logic", "affected")


def condition_eval(s, d):
    """Nations' conditions in disjunctive form, against the event types seen: closed world."""
    config = table(s, d, "events").select(F.col("event_type").alias("symbol")).distinct().withColumn("enabled", F.lit(True))
    alts = s.createDataFrame([(0, [[("error", False), ("click", True)]]), (1, [[("view", False)], [("missing", False)]]), (2, [[("missing", True), ("signup", False)]]), (3, [[("missing", False)]]), (4, [[]])], "n_regionkey int, alts array<array<struct<sym:string,neg:boolean>>>")
    cfg = config.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "enabled"))).alias("cfg"))
    return table(s, d, "nation").join(F.broadcast(alts), "n_regionkey").crossJoin(F.broadcast(cfg)).select("n_nationkey", condition.holds(F.col("alts"), F.col("cfg")).alias("affected"))


def or_absorb(s, d):
    """Alternatives per customer: an unconditional one absorbs the rest."""
    conds = table(s, d, "orders").select("o_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("")).otherwise(F.col("o_orderpriority")).alias("c"))
    return conds.groupBy("o_custkey").agg(condition.join_alternatives(F.array_sort(F.collect_set("c"))).alias("condition"))


def and_dedup(s, d):
    conds = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("own"))
    return conds.select("o_custkey", F.array_join(condition.conjoin(F.array(F.lit("F"), F.lit("X")), F.col("own")), " & ").alias("condition"))


# Reports.


def _results(s, d) -> DataFrame:
    found, _ = _findings(s, d)
    records = _records(s, d).select(F.concat(F.lit("none "), "rule_id").alias("rule_id"), "fix_date", "cmt_msg").unionByName(s.createDataFrame([("BUILDING", 1586000000, "a fix"), ("FURNITURE", None, "undated")], "rule_id string, fix_date long, cmt_msg string"))
    return report.results(found, records, file_verdicts(s, d), check_strict=True)


def report_json(s, d):
    """One JSON object a rule, keys in order, files too."""
    return report.report_json(_results(s, d).drop("fix_date", "cmt_msg"))


def report_document(s, d):
    """The whole report, written and read back: what was asked for, and how many files each rule has."""
    found = {r.rule_id: {"files": [{"file": f} for f in r.files], "config": {"affected": r.affected}} for r in _results(s, d).collect()}  # five segments
    path = scratch(s, "report") + "/report.json"
    report.write_document(s, path, report.document({"cve": sorted(found), "only_files": sorted(["net/", "drivers/"])}, {"full": "5.4.0"}, {}, {"treelens": "1"}, found))
    read = s.read.json(path, multiLine=True)
    names = [f for f in read.schema["results"].dataType.names]
    rows = F.array(*[F.struct(F.lit(n).alias("rule_id"), F.size(f"results.`{n}`.files").alias("n_files"), F.col(f"results.`{n}`.config.affected").alias("affected")) for n in names])
    return read.select(F.array_join("args.cve", " ").alias("asked"), F.array_join("args.only_files", " ").alias("only_files"), F.col("kernel.full").alias("kernel"), F.explode(rows).alias("r")).select("asked", "only_files", "kernel", "r.*")


def found_messages(s, d):
    return report.message(_results(s, d))


def verdict_messages(s, d):
    """What the console says of each rule's files and of the rule."""
    return report.verdict_message(file_verdicts(s, d), ".config")


def rules_listed(s, d):
    """Ids in lexical order, each with its place."""
    return report.listed(_rules(s, d)).select("rule_id", F.row_number().over(Window.orderBy("rule_id")).alias("place"))


_H = "substring(sha256(CAST({} AS VARCHAR)), 1, 40)"
_LINE_SQL = f"o AS (SELECT *, {_H.format('o_orderkey')} AS sha, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders)"
_CVE_SQL = "printf('CVE-2020-%07d', o_custkey)"
_CNA_SQL = f"cna AS (SELECT {_CVE_SQL} AS cve, any_value({_H.format('last')}) AS fixes, arg_min(sha, o_orderkey) AS breaks, CASE WHEN any_value(c_acctbal) < 0 THEN true END AS rejected FROM o JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority NOT IN ('5-LOW', '2-HIGH', '3-MEDIUM') GROUP BY o_custkey)"
_CIP_SQL = f"cip AS (SELECT {_CVE_SQL} AS cve, arg_max(sha, o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS fixes, arg_min(sha, o_orderkey) AS breaks, CASE WHEN any_value(c_mktsegment) IN ('BUILDING', 'FURNITURE') THEN true END AS rejected FROM o JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey)"
_FINDINGS_SQL = """f AS (SELECT c_mktsegment AS rule_id, CASE c_nationkey % 4 WHEN 0 THEN 'arch/arm/' WHEN 1 THEN 'arch/x86/' ELSE 'drivers/' END || c_custkey || CASE c_nationkey % 5 WHEN 0 THEN '.h' WHEN 1 THEN '.S' ELSE '.c' END AS path, c_nationkey % 4 = 0 AS elsewhere, c_nationkey % 6 AS n, c_nationkey % 5 = 0 AS header FROM customer),
  v AS (SELECT rule_id, path, CASE WHEN elsewhere THEN 'False' ELSE ['unknown', 'True', 'CONFIG_A & CONFIG_B', 'CONFIG_C', 'CONFIG_A & ~CONFIG_MISSING', '(CONFIG_A & CONFIG_B) | (CONFIG_A & CONFIG_C)'][n + 1] END AS logic, n <> 0 AS mapped, NOT elsewhere AND n <> 2 AS affected, CASE WHEN n <> 0 THEN '' WHEN header THEN 'debug' ELSE 'warning' END AS severity FROM f)"""
_KEPT_SQL = "k AS (SELECT rule_id, list_sort(list(path)) AS files, bool_or(affected) AS affected FROM v GROUP BY rule_id HAVING bool_or(affected))"

ORACLES = {
    "select_group": f"SELECT {_ID_SQL} AS rule_id FROM part WHERE p_brand LIKE 'Brand#1%'",
    "select_ids": f"SELECT {_ID_SQL} AS rule_id, p_partkey FROM part ORDER BY rule_id LIMIT 5",
    "exclude_ids": f"SELECT {_ID_SQL} AS rule_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)",
    "exclude_lists": "SELECT CAST(o_custkey AS VARCHAR) AS path, CASE WHEN o_orderstatus IN ('F', 'O') THEN printf('CVE-2020-%07d', o_orderkey) ELSE 'CVE-no id ' || o_orderkey END AS rule_id, o_orderstatus IN ('F', 'O') AS valid FROM orders",
    "exploit_only": "SELECT d.doc_id AS rule_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic = 1, false)",
    "prefix_any": f"SELECT {_ID_SQL} AS rule_id FROM part WHERE starts_with(p_type, 'PROMO') OR starts_with(p_type, 'STANDARD') OR starts_with(p_brand, 'Brand#2')",
    "prefix_ignore": f"SELECT {_ID_SQL} AS rule_id FROM part WHERE (p_type NOT LIKE '%.h' AND NOT (starts_with(p_type, 'PROMO') OR starts_with(p_type, 'Brand#2'))) OR (p_brand NOT LIKE '%.h' AND NOT (starts_with(p_brand, 'PROMO') OR starts_with(p_brand, 'Brand#2')))",
    "version_gate": f"SELECT {_ID_SQL} AS rule_id, p_size % 4 = 0 OR 10000 + 100 * (p_size % 3) + p_size % 12 <= 10102 AS runs FROM part",
    "option_layers": "SELECT CAST(s_suppkey AS VARCHAR) AS path, name, CASE name WHEN 'cve' THEN 'CVE-2020-0001 2020-0002' WHEN 'verbose' THEN CAST(s_nationkey AS VARCHAR) WHEN 'kernel' THEN '/src/' || s_suppkey WHEN 'exploit' THEN CASE WHEN s_acctbal > 0 THEN 'True' ELSE 'False' END END AS value FROM supplier, (VALUES ('cve'), ('verbose'), ('kernel'), ('exploit')) t(name)",
    "tree_paths": "SELECT 't' AS tree, 'a dir/r' || n_regionkey || '/' || n_name || '+1 %.c' AS path, 'int ' || n_name || ';' || chr(10) AS content FROM nation",
    "rule_headers": "SELECT printf('CVE-2020-%07d', p_partkey) AS rule_id, CASE WHEN p_size % 5 = 0 THEN 'grep' ELSE 'cocci' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'disputed' ELSE 'assigned' END AS grp, 'a/' || p_brand || '.c b.h' AS files, 'f' || p_partkey AS fix, CAST(p_size AS VARCHAR) AS fixes, '1.0.' || p_size AS min_version FROM part",
    "pattern_lines": "SELECT p_partkey AS rule_id, 2 AS pat_id, p_brand AS pattern FROM part UNION ALL SELECT p_partkey, 4, p_type FROM part",
    "config_symbols": "SELECT CAST(o_custkey AS VARCHAR) AS path, 'CONFIG_P' || substring(o_orderpriority, 1, 1) AS symbol, arg_max(o_orderstatus <> 'O', o_orderkey) AS enabled FROM orders GROUP BY ALL",
    "config_banners": "SELECT CAST(c_custkey AS VARCHAR) AS path, lower(c_mktsegment) AS arch, '5.' || c_nationkey || '.0' AS version FROM customer WHERE c_acctbal > 0",
    "kernel_versions": "SELECT c_custkey, '5' AS version, CAST(c_nationkey AS VARCHAR) AS patchlevel, CAST(c_custkey AS VARCHAR) AS sublevel, CASE WHEN c_acctbal > 0 THEN '-rc1' ELSE '' END AS extraversion, 'A Name' AS name, '5.' || c_nationkey || '.' || c_custkey || CASE WHEN c_acctbal > 0 THEN '-rc1' ELSE '' END AS full FROM customer",
    "metadata_round_trip": "SELECT 'CVE-' || s_suppkey AS rule_id, CASE WHEN s_acctbal > 0 THEN 'b' END AS breaks, s_suppkey AS fix_date, s_name AS cmt_msg, CASE WHEN s_acctbal < 0 THEN true END AS rejected, CASE WHEN s_nationkey < 9 THEN true END AS exploit FROM supplier",
    "exploited_catalogue": "SELECT DISTINCT 'CVE-' || n_nationkey AS cve FROM nation UNION SELECT 'CVE-0' FROM nation",
    "history_lines": f"WITH {_LINE_SQL} SELECT sha, CAST(floor(o_totalprice) AS BIGINT) AS committed_at, ' fix ' || o_orderpriority AS subject, CASE WHEN before IS NOT NULL THEN {_H.format('before')} END AS parent FROM o",
    "topological_order": f"WITH {_LINE_SQL} SELECT sha, CAST(nth - 1 AS INTEGER) AS depth FROM o",
    "commit_validate": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE lower(to_hex(o_orderkey * 7919 + 268435456)) END AS sha FROM orders",
    "commit_resolve": f"WITH {_LINE_SQL}, p AS (SELECT substring(sha, 1, 7) AS k7, substring(sha, 1, 12) AS k12, count(*) OVER (PARTITION BY substring(sha, 1, 7)) AS n7, count(*) OVER (PARTITION BY substring(sha, 1, 12)) AS n12, o_orderkey, o_orderstatus, sha FROM o) SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 3 = 0 THEN sha WHEN o_orderkey % 3 = 1 THEN CASE WHEN n12 = 1 THEN sha END ELSE CASE WHEN n7 = 1 THEN sha END END AS \"full\" FROM p UNION ALL SELECT -1, NULL UNION ALL SELECT -2, NULL",
    "mainline_commits": f"WITH {_LINE_SQL} SELECT sha FROM o WHERE o_custkey = (SELECT min(o_custkey) FROM orders)",
    "poset_extremum": f"WITH {_LINE_SQL}, u AS (SELECT o_custkey, arg_max(sha, o_orderkey) AS sha FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) SELECT 'one ' || o_custkey AS cve, sha FROM u UNION ALL SELECT 'pair ' || o_custkey // 2, any_value(sha) FROM u GROUP BY o_custkey // 2 HAVING count(*) = 1",
    "advisory_ranges": f"WITH {_LINE_SQL} SELECT {_CVE_SQL} AS cve, substring(sha, 1, 12) AS version, {_H.format('last')} AS less_than, c_acctbal < 0 AS rejected FROM o JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority NOT IN ('5-LOW', '2-HIGH', '3-MEDIUM')",
    "cna_records": f"WITH {_LINE_SQL}, {_CNA_SQL} SELECT * FROM cna",
    "cip_records": f"WITH {_LINE_SQL}, {_CIP_SQL} SELECT * FROM cip",
    "merged_records": f"WITH {_LINE_SQL}, {_CNA_SQL}, {_CIP_SQL} SELECT coalesce(a.cve, b.cve) AS cve, coalesce(a.fixes, b.fixes) AS fixes, coalesce(a.breaks, b.breaks) AS breaks, coalesce(a.rejected, b.rejected) AS rejected FROM cna a FULL OUTER JOIN cip b ON a.cve = b.cve",
    "enriched_records": f"WITH {_LINE_SQL}, {_CNA_SQL} SELECT cve, CAST(floor(o_totalprice) AS BIGINT) AS fix_date, 'fix ' || o_orderpriority AS cmt_msg, CASE WHEN c_nationkey < 9 THEN true END AS exploit, cna.rejected FROM cna JOIN o ON o.sha = fixes JOIN customer ON c_custkey = o_custkey",
    "source_counts": "SELECT 'advisories' AS source, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'issues', count(DISTINCT o_custkey) FROM orders",
    "coalesce_merge": "WITH l AS (SELECT s_suppkey AS cve, s_name AS fixes, CAST(NULL AS VARCHAR) AS breaks FROM supplier WHERE s_suppkey % 2 = 0), r AS (SELECT s_suppkey AS cve, CASE WHEN s_acctbal > 0 THEN 'paid' END AS fixes, 'r' AS breaks FROM supplier WHERE s_suppkey % 3 = 0) SELECT coalesce(l.cve, r.cve) AS cve, coalesce(r.fixes, l.fixes) AS fixes, coalesce(r.breaks, l.breaks) AS breaks FROM l FULL OUTER JOIN r ON l.cve = r.cve",
    "drop_empty": "SELECT doc_id, nullif(toxic, 0) AS toxic, nullif(quality, 0) AS quality, CASE WHEN toxic = 1 THEN true END AS flag, CASE WHEN quality = 1 THEN 'good' END AS word FROM labels",
    "rejected_text": "SELECT doc_id, starts_with(text, 'The ') OR starts_with(text, 'Der ') OR contains(text, 'License') OR contains(text, '| ') AS rejected FROM documents",
    "verdict_any": "SELECT n_name AS rule_id, bool_or(s_acctbal > 5000) AS affected FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name",
    "verdict_strict": "SELECT n_name AS rule_id, bool_or(s_acctbal > 5000) AS affected FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name HAVING coalesce(bool_or(s_acctbal > 5000), true)",
    "file_verdicts": f"WITH {_FINDINGS_SQL} SELECT * FROM v",
    "file_conditions": f"WITH {_FINDINGS_SQL} SELECT path, logic, CAST(NULL AS BOOLEAN) AS affected FROM v",
    "condition_eval": "WITH c AS (SELECT DISTINCT event_type AS s FROM events), f AS (SELECT 'error' IN (SELECT s FROM c) AS e, 'click' IN (SELECT s FROM c) AS k, 'view' IN (SELECT s FROM c) AS v, 'signup' IN (SELECT s FROM c) AS g, 'missing' IN (SELECT s FROM c) AS m) SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN e AND NOT k WHEN 1 THEN v OR m WHEN 2 THEN NOT m AND g WHEN 3 THEN m ELSE true END AS affected FROM nation, f",
    "or_absorb": "WITH c AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS c FROM orders) SELECT o_custkey, CASE WHEN bool_or(c = '') THEN '' WHEN count(*) = 1 THEN min(c) ELSE string_agg('(' || c || ')', ' | ' ORDER BY c) END AS condition FROM c GROUP BY o_custkey",
    "and_dedup": "WITH c AS (SELECT DISTINCT o_custkey, o_orderstatus AS c FROM orders) SELECT o_custkey, 'F & X' || coalesce(' & ' || string_agg(c, ' & ' ORDER BY c) FILTER (WHERE c NOT IN ('F', 'X')), '') AS condition FROM c GROUP BY o_custkey",
    "report_json": f"WITH {_FINDINGS_SQL}, {_KEPT_SQL} SELECT rule_id, '{{\"affected\":true,\"files\":[' || array_to_string(['\"' || x || '\"' for x in files], ',') || ']}}' AS json FROM k",
    "report_document": f"WITH {_FINDINGS_SQL}, {_KEPT_SQL} SELECT (SELECT string_agg(rule_id, ' ' ORDER BY rule_id) FROM k) AS asked, 'drivers/ net/' AS only_files, '5.4.0' AS kernel, rule_id, CAST(len(files) AS INTEGER) AS n_files, affected FROM k",
    "found_messages": f"WITH {_FINDINGS_SQL}, {_KEPT_SQL} SELECT rule_id, 'Found: ' || rule_id || chr(10) || CASE rule_id WHEN 'BUILDING' THEN 'MSG: a fix' || chr(10) || 'FIX DATE: 2020-04-04' || chr(10) WHEN 'FURNITURE' THEN 'MSG: undated' || chr(10) ELSE '' END || 'https://www.cve.org/CVERecord?id=' || rule_id AS text FROM k",
    "verdict_messages": f"WITH {_FINDINGS_SQL} SELECT rule_id, 'Affected Files:' || chr(10) || string_agg(' - ' || path || ': ' || logic || chr(10) || '   .config: ' || CASE WHEN affected THEN 'affected' ELSE 'not affected' END, chr(10) ORDER BY path) || chr(10) || 'Config: .config ' || CASE WHEN bool_or(affected) THEN 'affected' ELSE 'not affected' END AS text FROM v GROUP BY rule_id",
    "rules_listed": f"SELECT rule_id, CAST(row_number() OVER (ORDER BY rule_id) AS INTEGER) AS place FROM (SELECT DISTINCT {_ID_SQL} AS rule_id FROM part) t",
}
QUERIES = {name: globals()[name] for name in ORACLES}
