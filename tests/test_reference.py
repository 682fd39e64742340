"""Selection, conditions, makefiles, structural rules, readers and queries."""

import random

import duckdb
import pytest

from treelens import catalog
from treelens.functions import condition, makefile
from treelens.operators import metadata, regex_match, select, structural, verdict
from treelens.plans import buildmap, report
from treelens.sources import tree as sources

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = duck.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


CONFIG = {"CONFIG_A": True, "CONFIG_B": False}


@pytest.mark.parametrize(
    "logic, path, want",
    [
        (None, "drivers/x.c", ("unknown", True)),
        ("", "drivers/x.c", ("True", True)),
        ("CONFIG_A", "arch/arm/x.c", ("False", False)),
        ("CONFIG_A", "arch/x86/x.c", ("CONFIG_A", True)),
        ("CONFIG_A & CONFIG_B", "x.c", ("CONFIG_A & CONFIG_B", False)),
        ("(CONFIG_A) | (CONFIG_B & CONFIG_A)", "x.c", ("CONFIG_A", True)),
        ("CONFIG_MISSING", "x.c", ("CONFIG_MISSING", False)),
        ("~CONFIG_B", "x.c", ("~CONFIG_B", True)),
        ("CONFIG_A | ~CONFIG_A", "x.c", ("True", True)),
        (None, "arch/arm/x.c", ("False", False)),
        ("CONFIG_B | CONFIG_ABSENT", "x.c", ("CONFIG_ABSENT | CONFIG_B", False)),
        ("CONFIG_A | CONFIG_B", "x.c", ("CONFIG_A | CONFIG_B", True)),
        ("CONFIG_A & CONFIG_ABSENT", "x.c", ("CONFIG_A & CONFIG_ABSENT", False)),
    ],
)
def test_conditions(logic, path, want):
    assert condition.evaluate(logic, path, "x86", CONFIG) == want
    assert condition.evaluate(logic, path, "x86", None) == (want[0], None)


def test_build_map(spark):
    files = {
        "Kbuild": "obj-y += kernel/\nobj-$(CONFIG_NET) += net/\n",
        "kernel/Makefile": "obj-y += a.o\nobj-$(CONFIG_B) += comp.o\ncomp-y := one.o # first\ncomp-$(CONFIG_C) += two.o\nifeq ($(CONFIG_D),y)\nobj-y += d.o\nelse\nobj-y += e.o\nendif\nifeq ($(OTHER),y)\nobj-y += f.o\nendif\nobj-y += w$(BITS).o\nobj-$(CONFIG_S) += sub/ \\\n  g.o\n",
        "kernel/sub/Makefile": "obj-$(CONFIG_H) += h.o\nobj-$(CONFIG_I) += h.o\n",
        "net/Makefile": "include $(srctree)/net/more.mk\n",
        "net/more.mk": "obj-y += n.o\nobj-y += ../kernel/sub/\n",
    }
    rows = [("t", p, c) for p, c in files.items()] + [("t", p, "int x;") for p in ("kernel/a.c", "kernel/one.c", "kernel/two.c", "kernel/d.c", "kernel/e.c", "kernel/f.c", "kernel/g.S", "kernel/w32.c", "kernel/w64.c", "kernel/sub/h.c", "net/n.c")]
    got = {r.path: r.condition for r in buildmap.build_map(spark.createDataFrame(rows, "tree string, path string, content string")).collect()}
    assert got == {
        "kernel/a.c": "", "kernel/one.c": "CONFIG_B", "kernel/two.c": "CONFIG_B & CONFIG_C", "kernel/d.c": "CONFIG_D", "kernel/e.c": "~CONFIG_D", "kernel/w32.c": "", "kernel/w64.c": "", "kernel/g.S": "CONFIG_S",
        "kernel/sub/h.c": "(CONFIG_S & (CONFIG_H | CONFIG_I)) | (CONFIG_NET & (CONFIG_H | CONFIG_I))", "net/n.c": "CONFIG_NET",
    }
    assert makefile.srcarch("x86_64") == "x86" and makefile.srcarch("arm64") == "arm64"


VULNERABLE = "int f(int n)\n{\n\tint x = get(n);\n\tuse(x);\n\treturn 0;\n}\n"
FIXED = VULNERABLE.replace("\tuse(x);", "\tif (check(x))\n\t\treturn -1;\n\tuse(x);")
RULE = "/// Files: a.c\nvirtual detect\n@err exists@\nidentifier x;\nposition p;\n@@\nf(...)\n{\n...\nx = get(...);\n... when != check(x)\n* use(x)@p;\n...\n}\n"


def test_structural_pair(spark):
    nodes = structural.parse(RULE)
    assert structural.matches(nodes, VULNERABLE) == [4]
    assert structural.matches(nodes, FIXED) == []
    with pytest.raises(structural.UnsupportedRule):
        structural.parse(RULE.replace("...\nx =", "<+...x...+>\nx ="))
    files = spark.createDataFrame([("a.c", VULNERABLE), ("b.c", VULNERABLE)], "path string, content string")
    rules = spark.createDataFrame([("R", RULE, ["a.c"])], "rule_id string, body string, files array<string>")
    assert [tuple(r) for r in structural.scan(files, rules).collect()] == [("R", "a.c", 4)]


def test_structural_disjunctions_scripts_and_all_matches():
    text = "int f(void)\n{\n\tlock(a);\n\tuse(a);\n\tfree(a);\n\tuse(a);\n}\nint g(void)\n{\n\ttake(a);\n\tuse(a);\n}\n"
    body = "@err exists@\nidentifier x;\nposition p;\n@@\n(\nlock(x);\n|\ntake(x);\n)\n...\n* use(x)@p;\n"
    assert structural.matches(structural.parse(body), text) == [4, 6, 11]
    once = "@err exists@\nidentifier x;\nposition p;\n@@\nf(...)\n{\n...\n* use(x)@p;\n...\n}\n"
    assert structural.matches(structural.parse(once), text) == [4, 6]
    script = "\n@script:python depends on detect@\np << {}.p;\n{}@@\n\ncoccilib.report.print_report(p[0], 'ERROR')\n"
    assert structural.matches(structural.parse(once + script.format("err", "")), text) == [4, 6]
    other = "\n@two@\nposition q;\n@@\nmissing()@q;\n"
    assert structural.matches(structural.parse(once + other + script.format("err", "q << two.q;\n")), text) == []
    inside = once.replace("f(...)", "\\(f\\|g\\)(...)") + script.format("err", "").replace("coccilib", "if p[0].current_element in ('g', 'h'):\n    coccilib")
    assert structural.matches(structural.parse(inside), text) == [11]
    for bad in (once + script.format("err", "").replace("coccilib", "if len(p) > 1: coccilib"), body.replace("\n)\n", "\n"), body.replace("(\nlock", "lock"), body.replace("position p;", "position p : script:python() { p[0].current_element == 'f' };")):
        with pytest.raises(structural.UnsupportedRule):
            structural.parse(bad)


def test_sources(spark, tmp_path):
    (tmp_path / "rules/disputed").mkdir(parents=True)
    (tmp_path / "rules/CVE-2020-0001.grep").write_text("/// Files: a.c\tb.c\n/// Fix: abc\n/// Detect-To: def\n/// Version: 1.0.8\n// note\n\nfoo\\(\n")
    (tmp_path / "rules/disputed/CVE-2020-0002.cocci").write_text("/// Files: c.c\n@@\n@@\n")
    rules = sources.rules(spark, str(tmp_path / "rules"))
    got = {r.rule_id: r for r in rules.collect()}
    one = got["CVE-2020-0001"]
    assert (one.kind, one.grp, one.files, one.fix, one.fixes, one.min_version) == ("grep", "assigned", ["a.c", "b.c"], "abc", "def", "1.0.8")
    assert got["CVE-2020-0002"].grp == "disputed"
    assert [r.pattern for r in sources.patterns(rules).collect()] == ["foo\\("]
    (tmp_path / "config").write_text("# Linux/x86_64 5.4.0 Kernel Configuration\nCONFIG_A=y\nCONFIG_B=m\n# CONFIG_C is not set\nCONFIG_A=n\n")
    assert {r.symbol: r.enabled for r in sources.config(spark, str(tmp_path / "config")).collect()} == {"CONFIG_A": True, "CONFIG_B": True, "CONFIG_C": False}
    assert sources.config_banner(spark, str(tmp_path / "config")).first()[:] == ("x86_64", "5.4.0")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.c").write_text("foo(1)")
    files = sources.files(spark, str(tmp_path / "src"))
    assert [(r.path, r.content) for r in files.collect()] == [("a.c", "foo(1)")]
    found = report.findings(rules, sources.patterns(rules), files)
    assert [tuple(r) for r in found.collect()] == [("CVE-2020-0001", "a.c")]
    meta = spark.createDataFrame([("CVE-2020-0001", 1586000000, "msg")], "rule_id string, fix_date long, cmt_msg string")
    told = verdict.file_verdicts(found, spark.createDataFrame([("a.c", "CONFIG_B")], "path string, condition string"), "x86", {"CONFIG_B": True})
    rows = report.results(found, meta, told, check_strict=True)
    assert rows.first().affected is True
    assert "FIX DATE: 2020-04-04" in report.message(rows).first().text


def test_selection(spark):
    rules = spark.createDataFrame([("CVE-2020-0001", "assigned"), ("CVE-2020-0002", "disputed")], "rule_id string, grp string")
    ids = lambda df: sorted(r.rule_id for r in df.collect())
    assert ids(select.choose(rules, ["all"])) == ["CVE-2020-0001", "CVE-2020-0002"]
    assert ids(select.choose(rules, ["2020-0002"])) == ["CVE-2020-0002"]
    assert ids(select.excluding(rules, ["CVE-2020-0001", "CVE-1999-9999"])) == ["CVE-2020-0002"]
    with pytest.raises(ValueError):
        select.choose(rules, ["CVE-2020-9999"])
    with pytest.raises(regex_match.UnsupportedPattern):
        regex_match.check_pattern(r"a\Kb")


def test_commit_resolve_in_a_history_with_a_commit_of_zeros(spark, tmp_path):
    """The commit of order 665782 starts with seven zeros."""
    with duckdb.connect() as con:
        con.execute(f"COPY (SELECT * REPLACE (CAST(665782 AS BIGINT) AS o_orderkey, 'F' AS o_orderstatus) FROM '{SF}/orders.parquet' LIMIT 1) TO '{tmp_path}/orders.parquet'")
        con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
        want = sorted(con.execute(catalog.oracle_sql()["commit_resolve"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["commit_resolve"](spark, str(tmp_path)).select("o_orderkey", "full").collect()) == want
    commits = spark.createDataFrame([("0000000" + "a" * 33,)], "sha string")
    assert [r.full for r in metadata.resolve(spark.createDataFrame([("0000000",)], "sha string"), commits).collect()] == ["0000000" + "a" * 33]


def test_extremum(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "a")], "sha string, parent string")
    candidates = spark.createDataFrame([("X", "a"), ("X", "b"), ("Y", "b"), ("Y", "c")], "cve string, sha string")
    assert [tuple(r) for r in metadata.extremum(candidates, parents, latest=True).collect()] == [("X", "b")]
    assert [tuple(r) for r in metadata.extremum(candidates, parents, latest=False).collect()] == [("X", "a")]


def test_extremum_far_apart(spark):
    """Candidates more than 1000 commits apart, on a line with merges and a side branch."""
    line = [(f"n{i}", f"n{i + 1}") for i in range(1500)]
    parents = spark.createDataFrame([*line, ("n700", "s0"), ("s0", "s1"), ("s1", "n900"), ("z", "n1200")], "sha string, parent string")
    candidates = spark.createDataFrame([("X", "n1"), ("X", "n1400"), ("Y", "n1"), ("Y", "n800"), ("Y", "s1"), ("Z", "z"), ("Z", "n1"), ("Z", "n1300")], "cve string, sha string")
    assert sorted(tuple(r) for r in metadata.extremum(candidates, parents, latest=True).collect()) == [("X", "n1"), ("Y", "n1")]
    assert sorted(tuple(r) for r in metadata.extremum(candidates, parents, latest=False).collect()) == [("X", "n1400"), ("Z", "n1300")]


def test_extremum_of_many_candidates_on_a_line_needs_few_tables(spark, monkeypatch):
    """Their places decide: no history is followed from candidate to candidate, a table or two a step."""
    made, cut = [], metadata.cut
    monkeypatch.setattr(metadata, "cut", lambda df, *what: made.append(df) or cut(df, *what))
    parents = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30)], "sha string, parent string")
    candidates = spark.createDataFrame([("X", f"n{i:02}") for i in range(31)], "cve string, sha string")
    for latest, sha in ((True, "n00"), (False, "n30")):
        made.clear()
        assert [tuple(r) for r in metadata.extremum(candidates, parents, latest).collect()] == [("X", sha)]
        assert len(made) <= 10


@pytest.mark.parametrize("seed", range(2))
def test_extremum_equals_brute_force(spark, seed):
    """Random histories with forks, merges and several roots, and sets of one to four candidates."""
    draw = random.Random(seed)
    above = {i: sorted(draw.sample(range(i), min(i, draw.choice((0, 1, 1, 1, 1, 1, 2, 2, 3))))) if i < 20 or draw.random() < 0.4 else [i - 1] for i in range(60)}
    name = {i: f"{draw.randrange(16**6):06x}-{i}" for i in above}
    reach = {}
    for i, up in above.items():
        reach[i] = {i}.union(*(reach[u] for u in up))
    sets = {f"C{n}": draw.sample(range(60), draw.randint(1, 4)) for n in range(150)}
    parents = spark.createDataFrame([(name[i], name[u]) for i, up in above.items() for u in up], "sha string, parent string")
    candidates = spark.createDataFrame([(c, name[i]) for c, s in sets.items() for i in s], "cve string, sha string")
    for latest in (True, False):
        want = {(c, name[x]) for c, s in sets.items() for x in s if all((y in reach[x]) if latest else (x in reach[y]) for y in s)}
        got = [tuple(r) for r in metadata.extremum(candidates, parents, latest).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_mainline_and_ids_of_a_history(spark):
    """Only the mainline counts; an id that starts a commit of another branch too is none; a circle ends the search too."""
    m, twin, side = "a" * 40, "a" * 12 + "b" * 28, "c" * 40
    commits = spark.createDataFrame([(m,), (twin,), (side,), ("d" * 40,)], "sha string")
    parents = spark.createDataFrame([("d" * 40, m), (side, m)], "sha string, parent string")
    values = spark.createDataFrame([("A", "a" * 12), ("B", "a" * 13), ("B", "d" * 9), ("C", m), ("C", side), ("D", side), ("E", "never")], "cve string, sha string")
    mainline = metadata.ancestors(spark.createDataFrame([("d" * 40,)], "sha string"), parents)
    got = metadata.select_commit(values, commits, parents, mainline, latest=True)
    assert sorted(tuple(r) for r in got.collect()) == [("B", "d" * 40), ("C", m)]
    around = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "w")], "sha string, parent string")
    asked = spark.createDataFrame([("X", "x"), ("X", "y"), ("Z", "z"), ("Z", "w")], "cve string, sha string")
    assert [tuple(r) for r in metadata.extremum(asked, around, latest=True).collect()] == [("Z", "z")]


def test_long_conditions_stay_short():
    """Beyond eight symbols nothing is expanded, and the verdict is that of the formula."""
    text = " & ".join(f"(C{i} | A{i} | B{i} | C{i})" for i in range(30))
    logic, affected = condition.evaluate(text, "x.c", "x86", {f"B{i}": True for i in range(30)})
    assert logic == " & ".join(sorted(f"(A{i} | B{i} | C{i})" for i in range(30))) and affected is True
    assert condition.evaluate(text, "x.c", "x86", {f"B{i}": True for i in range(29)})[1] is False


@pytest.mark.parametrize(
    "body",
    [
        "@r@\n@@\nf(...)\n{\n... when exists\ng();\n}\n",
        "@r@\n@@\nf(...)\n{\n... when forall\ng();\n}\n",
        "@r@\n@@\nif (<+... x ...+>) S\n",
        "@initialize:python@\n@@\nx = 1\n\n@r@\n@@\ng();\n",
        "@r@\nexpression list E;\n@@\ng(E);\n",
        "@r@\nidentifier x =~ \"^a\";\n@@\nx();\n",
        "@r extends s@\n@@\ng();\n",
        "@r@\nidentifier s.x;\n@@\nx();\n",
        "@r@\n@@\n#define F(...) x\n",
        "no rule",
    ],
)
def test_what_the_matcher_refuses(spark, body):
    with pytest.raises(structural.UnsupportedRule):
        structural.parse(body)
    rules = spark.createDataFrame([("BAD", body, ["a.c"]), ("GOOD", "@r@\n@@\n* g();\n", ["a.c"])], "rule_id string, body string, files array<string>")
    assert [(r.rule_id, r.reason is None) for r in structural.judged(rules).orderBy("rule_id").collect()] == [("BAD", False), ("GOOD", True)]
    files = spark.createDataFrame([("a.c", "void f(void)\n{\n\tg();\n}\n")], "path string, content string")
    for all_files in (False, True):
        assert [tuple(r) for r in structural.scan(files, rules, all_files).collect()] == [("GOOD", "a.c", 3)]


def test_ancestors_through_merges(spark):
    """A long line with side branches, some of them merged twice, and commits that the tip doesn't reach."""
    edges = [(f"m{i}", f"m{i + 1}") for i in range(300)] + [("m10", "s0"), ("s0", "s1"), ("s1", "t0"), ("t0", "m200"), ("s1", "m40"), ("x", "m5"), ("y", "x")]
    parents = spark.createDataFrame(edges, "sha string, parent string")
    got = {r.sha for r in metadata.ancestors(spark.createDataFrame([("m0",)], "sha string"), parents).collect()}
    assert got == {f"m{i}" for i in range(301)} | {"s0", "s1", "t0"}
    refs = spark.createDataFrame([("HEAD", "h"), ("refs/heads/master", "m0"), ("refs/heads/other", "x")], "ref string, sha string")
    assert [r.sha for r in metadata.mainline_tip(refs).collect()] == ["m0"] and metadata.mainline_tip(refs.where("sha = 'x'")).count() == 0


def test_rejected_records_without_ranges_are_dropped(spark):
    rows = [("/v/cve/rejected/2020/CVE-2020-0001.json", '{"containers":{"cna":{}}}'), ("/v/cve/published/2020/CVE-2020-0002.json", '{"cveMetadata":{"cveId":"CVE-2020-0002","cveID":"other"},"containers":{"cna":{"affected":[{"versions":[{"versionType":"git","status":"affected","version":"0","lessThan":"' + "a" * 40 + '"}]}]}}}')]
    records = sources.advisories_of(spark.createDataFrame(rows, "path string, content string"))
    assert sorted((r.cve, r.rejected) for r in records.collect()) == [("CVE-2020-0001", True), ("CVE-2020-0002", False)]
    commits = spark.createDataFrame([("a" * 40, 1, "s")], "sha string, committed_at long, subject string")
    parents = spark.createDataFrame([], "sha string, parent string")
    assert [tuple(r) for r in metadata.cna_records(records, commits, parents).collect()] == [("CVE-2020-0002", "a" * 40, None, None)]


def test_readers_of_single_files(spark, tmp_path):
    (tmp_path / "ids").write_text("# a list\n2020-0001\nCVE-2020-00002\n")
    assert [r.rule_id for r in sources.exclude_list(spark, str(tmp_path / "ids")).collect()] == ["CVE-2020-0001", "CVE-2020-00002"]
    (tmp_path / "bad").write_text("nonsense\n")
    with pytest.raises(ValueError, match="nonsense"):
        sources.exclude_list(spark, str(tmp_path / "bad"))
    (tmp_path / "issues").mkdir()
    (tmp_path / "issues/CVE-2020-0003.yml").write_text("fixed-by:\n  mainline: [abc]\nintroduced-by: never\nignore:\n  all: Not a kernel thing\n")
    assert [tuple(r) for r in sources.issues(spark, str(tmp_path / "issues")).collect()] == [("CVE-2020-0003", ["abc"], [], "Not a kernel thing")]
    (tmp_path / "v/cve/published").mkdir(parents=True)
    (tmp_path / "v/cve/published/CVE-2020-0004.json").write_text('{"cveMetadata":{"cveId":"CVE-2020-0004"},"containers":{"cna":{"affected":[]}}}')
    assert [(r.cve, r.rejected) for r in sources.advisories(spark, str(tmp_path / "v")).collect()] == [("CVE-2020-0004", False)]
    (tmp_path / "kev.json").write_text('{"vulnerabilities":[{"cveID":"CVE-1"},{"cveID":"CVE-1"}]}')
    assert [r.cve for r in sources.exploited(spark, str(tmp_path / "kev.json")).collect()] == ["CVE-1"]
    (tmp_path / "log").write_text("\t".join(["b" * 40, "a" * 40 + " " + "c" * 40, "7", "a\ttab"]) + "\n" + "\t".join(["a" * 40, "", "6", "first"]) + "\n")
    commits, parents = sources.history(spark, str(tmp_path / "log"))
    assert sorted(tuple(r) for r in commits.collect()) == [("a" * 40, 6, "first"), ("b" * 40, 7, "a\ttab")]
    assert sorted(tuple(r) for r in parents.collect()) == [("b" * 40, "a" * 40, 0), ("b" * 40, "c" * 40, 1)]
