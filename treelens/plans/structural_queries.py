"""Structural rules over a C file for each customer, and where SQL says that they match."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.operators import structural
from treelens.plans.scan import table

_SAYS = "\n@script:python depends on detect@\n{}@@\n\n{}coccilib.report.print_report(p[0], 'ERROR')\n"
_SCRIPT = _SAYS.format("p << err.p;\n", "")
_HAS = "@has@\nidentifier x;\nposition p;\n@@\nif (x > LIMIT)@p return -1;\n\n"
_BODY = "f(...)\n{{\n\t...\n{}\t...\n}}\n"

#: name -> (rule, SQL of its lines: of c, with u the line of the first use and e the one that ends f)
RULES = {
    "function_anchor": ("@err exists@\nidentifier x;\nposition p;\n@@\n" + _BODY.format("\tuse(x)@p;\n") + _SCRIPT, "SELECT c_custkey, u AS line FROM c UNION ALL SELECT c_custkey, u + 1 FROM c WHERE b = 1"),
    "context_lines": ("@err exists@\n@@\n" + _BODY.format("*\treturn 0;\n"), "SELECT c_custkey, u + b + 1 AS line FROM c"),
    "argument_gap": ("@err@\nposition p;\n@@\nput_HOUSEHOLD(p, n, ...)@p;\n" + _SCRIPT, "SELECT c_custkey, e + 3 AS line FROM c WHERE seg = 'HOUSEHOLD'"),
    "gap_absence": ("@err exists@\nidentifier x;\nposition p;\n@@\nx = get(...);\n... when != x > LIMIT\nuse(x)@p;\n" + _SCRIPT, "SELECT c_custkey, u AS line FROM c WHERE a = 0 UNION ALL SELECT c_custkey, u + 1 FROM c WHERE a = 0 AND b = 1"),
    "gap_any": ("@err exists@\nidentifier x;\nposition p;\n@@\nx = get(...);\n...\twhen any\nuse(x)@p;\n" + _SCRIPT, "SELECT c_custkey, u AS line FROM c UNION ALL SELECT c_custkey, u + 1 FROM c WHERE b = 1"),
    "inline_choice": ("@err@\nposition p;\n@@\n\\(put_BUILDING\\|put_MACHINERY\\)(...)@p;\n" + _SCRIPT, "SELECT c_custkey, e + 3 AS line FROM c WHERE seg IN ('BUILDING', 'MACHINERY')"),
    "block_choice": ("@err@\nposition p;\n@@\ng(...)\n{\n\t...\n(\n\tput_BUILDING(p, n);\n|\n\tput_FURNITURE(p, n);\n)\n\tget(n)@p;\n\t...\n}\n" + _SCRIPT, "SELECT c_custkey, e + 4 AS line FROM c WHERE seg IN ('BUILDING', 'FURNITURE')"),
    "rule_dependency": (_HAS + "@seg@\n@@\nput_HOUSEHOLD(...);\n\n@other@\n@@\nput_BUILDING(...);\n\n@err depends on (seg || other) && !has exists@\nposition p;\n@@\nget(n)@p;\n" + _SCRIPT, "SELECT c_custkey, 8 AS line FROM c WHERE a = 0 AND seg IN ('HOUSEHOLD', 'BUILDING') UNION ALL SELECT c_custkey, e + 4 FROM c WHERE a = 0 AND seg IN ('HOUSEHOLD', 'BUILDING')"),
    "rule_never": (_HAS + "@err depends on never has disable neg_if exists@\nposition p;\n@@\nreturn 0@p;\n" + _SCRIPT, "SELECT c_custkey, u + b + 1 AS line FROM c WHERE a = 0"),
    "operator_set": ("@err@\nidentifier x;\nexpression E;\nbinary operator cmp = {>, >=};\nposition p;\n@@\nif (x cmp E)@p return -1;\n\n@none@\nidentifier x;\nbinary operator cmp = {<, <=};\nposition p;\n@@\nif (x cmp LIMIT)@p return -1;\n" + _SCRIPT + _SAYS.format("p << none.p;\n", ""), "SELECT c_custkey, 9 AS line FROM c WHERE a = 1"),
    "assignment_operator": ("@err@\nidentifier q;\nassignment operator op;\nposition p;\n@@\nq->len op@p n;\n" + _SCRIPT, "SELECT c_custkey, e + 5 AS line FROM c"),
    "inherited_name": ("@s@\nidentifier t;\n@@\nstruct t {\n\t...\n};\n\n@err@\nidentifier s.t;\nidentifier q;\nposition p;\n@@\ng(struct t *q@p, ...)\n" + _SCRIPT, "SELECT c_custkey, e + 1 AS line FROM c WHERE b = 1"),
    "position_apart": ("@stub@\nidentifier x;\nposition p;\n@@\nint x = get(n)@p;\n\n@err@\nposition p != stub.p;\n@@\nget(n)@p;\n" + _SCRIPT, "SELECT c_custkey, e + 4 AS line FROM c"),
    "struct_members": ("@err@\nidentifier t;\ntypedef u8;\nposition p;\n@@\nstruct t {\n\t...\n\tu8 len@p;\n\t...\n};\n" + _SCRIPT, "SELECT c_custkey, 3 AS line FROM c WHERE n % 3 <> 0"),
    "macro_value": ("@err@\nposition p;\n@@\n#define LIMIT 7@p\n" + _SCRIPT, "SELECT c_custkey, 5 AS line FROM c WHERE n = 7"),
    "script_and_or": (_HAS + "@seg@\nposition p;\n@@\nput_FURNITURE(...)@p;\n\n@machine@\nposition p;\n@@\nput_MACHINERY(...)@p;\n" + _SAYS.format("p << has.p;\nq << seg.p;\n", "") + _SAYS.format("p << machine.p;\n", ""), "SELECT c_custkey, 9 AS line FROM c WHERE a = 1 AND seg = 'FURNITURE' UNION ALL SELECT c_custkey, e + 3 FROM c WHERE (a = 1 AND seg = 'FURNITURE') OR seg = 'MACHINERY'"),
    "span_filter": ("@err@\nposition p;\n@@\nget(n)@p;\n" + _SAYS.format("p << err.p;\n", "if p[0].current_element == 'g':\n    "), "SELECT c_custkey, e + 4 AS line FROM c"),
    "virtual_modes": ("virtual config\n@err@\nposition p;\n@@\nuse(x)@p;\n\n@other@\nposition p;\n@@\nreturn 0@p;\n" + _SAYS.replace("detect", "config").format("p << err.p;\n", "") + _SAYS.format("p << other.p;\n", ""), "SELECT c_custkey, u + b + 1 AS line FROM c"),
}
_SQL = "WITH t AS (SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS a, CAST(c_nationkey % 2 = 0 AS INTEGER) AS b, c_mktsegment AS seg, c_nationkey AS n FROM customer), c AS (SELECT *, 9 + a AS u, 9 + a + b + 2 AS e FROM t) "


def files(s: SparkSession, d: str) -> DataFrame:
    """A struct, a macro, f with perhaps a check and a second use, and g, by each customer's balance, nation and segment."""
    a, b = F.col("c_acctbal") < 0, F.col("c_nationkey") % 2 == 0
    lines = [
        F.concat(F.lit("struct s_"), "c_mktsegment", F.lit(" {")), F.lit("\tint size;"), F.concat(F.lit("\tu"), F.when(F.col("c_nationkey") % 3 == 0, "16").otherwise("8"), F.lit(" len;")), F.lit("};"), F.concat(F.lit("#define LIMIT "), "c_nationkey"),
        F.lit("int f(int n)"), F.lit("{"), F.lit("\tint x = get(n); /* not x > LIMIT */"), F.when(a, "\tif (x > LIMIT) return -1;"), F.lit("\tuse(x);"), F.when(b, "\tuse(x);"), F.lit("\treturn 0;"), F.lit("}"),
        F.concat(F.lit("int g(struct s_"), F.when(b, F.col("c_mktsegment")).otherwise("other"), F.lit(" *p, int n)")), F.lit("{"), F.concat(F.lit("\tput_"), "c_mktsegment", F.lit("(p, n);")), F.lit("\tget(n);"), F.lit("\tp->len = n;"), F.lit("}"), F.lit(""),
    ]
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.array_join(F.array_compact(F.array(*lines)), "\n").alias("content"))


def _run(name: str, s: SparkSession, d: str) -> DataFrame:
    rules = s.createDataFrame([(name, "virtual detect\n" + RULES[name][0])], "rule_id string, body string")
    return structural.scan(files(s, d), rules, all_files=True).select(F.col("path").cast("long").alias("c_custkey"), "line")


def structural_scan(s: SparkSession, d: str) -> DataFrame:
    """Three rules over the files that they name, which are those of a segment; one of the rules can't be read."""
    bodies = s.createDataFrame([("AUTOMOBILE", "virtual detect\n" + RULES["gap_absence"][0]), ("BUILDING", "virtual detect\n" + RULES["inline_choice"][0]), ("FURNITURE", "@err@\n@@\n<+... use(x) ...+>\n")], "c_mktsegment string, body string")
    named = table(s, d, "customer").join(F.broadcast(bodies), "c_mktsegment").groupBy(F.col("c_mktsegment").alias("rule_id"), "body").agg(F.collect_list(F.col("c_custkey").cast("string")).alias("files"))
    return structural.scan(files(s, d), named).select("rule_id", F.col("path").cast("long").alias("c_custkey"), "line")


QUERIES = {name: partial(_run, name) for name in RULES} | {"structural_scan": structural_scan}
ORACLES = {name: _SQL + f"SELECT c_custkey, CAST(line AS INTEGER) AS line FROM ({sql}) x" for name, (_, sql) in RULES.items()} | {
    "structural_scan": _SQL + "SELECT seg AS rule_id, c_custkey, CAST(u + i AS INTEGER) AS line FROM c, (VALUES (0), (1)) t(i) WHERE seg = 'AUTOMOBILE' AND a = 0 AND (i = 0 OR b = 1) UNION ALL SELECT seg, c_custkey, CAST(e + 3 AS INTEGER) FROM c WHERE seg = 'BUILDING'",
}
