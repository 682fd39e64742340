"""Build maps of small trees, one for each supplier, and their SQL: what each makefile construct says of a file.

In the texts {n} is the supplier's nation and {m} is ``y`` or, if the balance isn't positive, ``$(CONFIG_Q)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions.makefile import resolve_arch, source_of, srcarch
from treelens.plans import buildmap
from treelens.plans.scan import table

#: name -> (architecture, makefiles, other files, (path, condition, condition if {m} isn't y))
TREES = {
    "kb_root_kbuild": (
        "x86",
        {
            "Kbuild": "obj-y += init/\nobj-{m} += net\nobj-$(CONFIG_N{n}) += lib/ missing/\nifeq ($(KBUILD_EXTMOD),)\nobj-y += mm/ # in a block that can't be read\nendif\n",
            "init/Makefile": "obj-y += main.o\nobj-m += mod.o\n", "net/Kbuild": "obj-$(CONFIG_A) += a.o\n", "net/Makefile": "obj-y += never.o\n",
            "lib/Makefile": "obj-y += one.o sub/\nobj-$(CONFIG_B) += sub/\n", "lib/sub/Makefile": "lib-$(CONFIG_C) += c.o\nlib-${CONFIG_C} += d.o\n", "mm/Makefile": "obj-y += m.o\n",
        },
        "init/main.c init/mod.c net/a.c net/never.c lib/one.c lib/sub/c.S lib/sub/d.c mm/m.c",
        [("init/main.c", "", ""), ("init/mod.c", "", ""), ("net/a.c", "CONFIG_A", "CONFIG_Q & CONFIG_A"), ("lib/one.c", "CONFIG_N{n}", "CONFIG_N{n}"), ("lib/sub/c.S", "CONFIG_N{n} & CONFIG_C", "CONFIG_N{n} & CONFIG_C"), ("lib/sub/d.c", "CONFIG_N{n} & CONFIG_C", "CONFIG_N{n} & CONFIG_C"), ("mm/m.c", "", "")],
    ),
    "kb_top_makefile": (
        "x86_64",
        {
            "Makefile": "core-y := init/ usr/\ndrivers-{m} += drivers/\nnet-$(CONFIG_NET) := net/\nvirt-y += virt\n", "arch/x86/Makefile": "core-y += arch/x86/\nnet-$(CONFIG_OVER) += net/\nlibs-$(CONFIG_L{n}) += arch/x86/lib/\n",
            "init/Makefile": "obj-y += main.o\n", "drivers/Makefile": "obj-$(CONFIG_D) += d.o\n", "net/Makefile": "obj-y += n.o\n", "virt/Makefile": "obj-y += v.o\n", "arch/x86/Kbuild": "obj-y += kernel/\n", "arch/x86/kernel/Makefile": "obj-y += s.o\n",
            "arch/x86/lib/Makefile": "obj-y += l.o\n", "firmware/Makefile": "obj-y += f.o\n", "sound/Makefile": "obj-$(CONFIG_S) += s.o\n", "other/Makefile": "obj-y += x.o\n",
        },
        "init/main.c drivers/d.c net/n.c virt/v.c arch/x86/kernel/s.c arch/x86/lib/l.c firmware/f.c sound/s.c other/x.c",
        [("init/main.c", "", ""), ("drivers/d.c", "CONFIG_D", "CONFIG_Q & CONFIG_D"), ("net/n.c", "CONFIG_OVER", "CONFIG_OVER"), ("virt/v.c", "", ""), ("arch/x86/kernel/s.c", "", ""), ("arch/x86/lib/l.c", "CONFIG_L{n}", "CONFIG_L{n}"), ("firmware/f.c", "", ""), ("sound/s.c", "CONFIG_S", "CONFIG_S")],
    ),
    "kb_arm": (
        "arm",
        {"arch/arm/Makefile": "machine-$(CONFIG_ARCH_N{n}) += foo bar\nplat-{m} := one\ncore-y += arch/arm/kernel/\n", "arch/arm/mach-foo/Makefile": "obj-y += a.o\n", "arch/arm/plat-one/Makefile": "obj-$(CONFIG_Z) += b.o\n", "arch/arm/kernel/Makefile": "obj-y += c.o\n"},
        "arch/arm/mach-foo/a.c arch/arm/plat-one/b.c arch/arm/kernel/c.S",
        [("arch/arm/mach-foo/a.c", "CONFIG_ARCH_N{n}", "CONFIG_ARCH_N{n}"), ("arch/arm/plat-one/b.c", "CONFIG_Z", "CONFIG_Q & CONFIG_Z"), ("arch/arm/kernel/c.S", "", "")],
    ),
    "kb_blackfin": (
        "blackfin",
        {"arch/blackfin/Makefile": "machine-$(CONFIG_BF{n}) := bf5\nmachine-{m} += bf6\nplat-y += none\n", "arch/blackfin/mach-bf5/Makefile": "obj-y += a.o\n", "arch/blackfin/mach-bf5/boards/Makefile": "obj-$(CONFIG_B) += b.o\n", "arch/blackfin/mach-bf6/Makefile": "obj-y += c.o\n", "arch/blackfin/plat-none/Makefile": "obj-y += d.o\n"},
        "arch/blackfin/mach-bf5/a.c arch/blackfin/mach-bf5/boards/b.c arch/blackfin/mach-bf6/c.c arch/blackfin/plat-none/d.c",
        [("arch/blackfin/mach-bf5/a.c", "CONFIG_BF{n}", "CONFIG_BF{n}"), ("arch/blackfin/mach-bf5/boards/b.c", "CONFIG_BF{n} & CONFIG_B", "CONFIG_BF{n} & CONFIG_B"), ("arch/blackfin/mach-bf6/c.c", "", "CONFIG_Q")],
    ),
    "kb_mips": (
        "mips",
        {"arch/mips/Makefile": "include $(srctree)/arch/mips/Kbuild.platforms\nlibs-{m} += arch/mips/lib/\n", "arch/mips/Kbuild.platforms": "platforms += one\nplatforms += two\n", "arch/mips/one/Platform": "platform-$(CONFIG_ONE_N{n}) += one/\n", "arch/mips/one/Makefile": "obj-y += a.o\n", "arch/mips/two/Platform": "# nothing\n", "arch/mips/two/Makefile": "obj-y += b.o\n", "arch/mips/lib/Makefile": "lib-y += c.o\n"},
        "arch/mips/one/a.c arch/mips/two/b.c arch/mips/lib/c.S",
        [("arch/mips/one/a.c", "CONFIG_ONE_N{n}", "CONFIG_ONE_N{n}"), ("arch/mips/lib/c.S", "", "CONFIG_Q")],
    ),
    "kb_variables": (
        "x86",
        {
            "Kbuild": "obj-y += k/\n",
            "k/Makefile": "include $(srctree)/k/more.mk\ninclude nothere.mk\nDIR := sub\nobj-y += $(DIR)/u.o\nLIST := $(addprefix sub/, v.o w.o)\nobj-$(CONFIG_N{n}:m=y) += $(LIST)\nobj-$(subst m,y,$(CONFIG_S)) += s.o \\\n\tt.o\nADD := $(addsuffix .o, x y)\nobj-{m} += $(ADD)\n",
            "k/more.mk": "UP ?= ../k\nobj-$(CONFIG_I) += $(UP)/inc.o # from here\n",
        },
        "k/sub/u.c k/sub/v.c k/sub/w.c k/s.c k/t.c k/x.c k/y.c k/inc.c",
        [("k/sub/u.c", "", ""), ("k/sub/v.c", "CONFIG_N{n}", "CONFIG_N{n}"), ("k/sub/w.c", "CONFIG_N{n}", "CONFIG_N{n}"), ("k/s.c", "CONFIG_S", "CONFIG_S"), ("k/t.c", "CONFIG_S", "CONFIG_S"), ("k/x.c", "", "CONFIG_Q"), ("k/y.c", "", "CONFIG_Q"), ("k/inc.c", "CONFIG_I", "CONFIG_I")],
    ),
    "kb_conditionals": (
        "x86",
        {
            "Kbuild": "obj-y += k/\n",
            "k/Makefile": "ifeq ($(CONFIG_N{n}),y)\nobj-y += a.o\nelse\nobj-y += b.o\nendif\nifneq ($(CONFIG_E),)\nobj-y += c.o\nendif\nifdef CONFIG_F\nobj-$(CONFIG_G) += d.o\nendif\nifeq ($(SHELL),sh)\nobj-y += e.o\nifdef CONFIG_H\nobj-y += f.o\nendif\nelse\nobj-y += g.o\nendif\nobj-{m} += w$(BITS).o\nsubdir-$(CONFIG_SUB) += sub\nobj-y += $(filter-out a.o, h.o)\n",
            "k/sub/Makefile": "obj-y += z.o\n",
        },
        "k/a.c k/b.c k/c.c k/d.c k/e.c k/f.c k/g.c k/h.c k/w32.c k/w64.c k/sub/z.c",
        [("k/a.c", "CONFIG_N{n}", "CONFIG_N{n}"), ("k/b.c", "~CONFIG_N{n}", "~CONFIG_N{n}"), ("k/c.c", "CONFIG_E", "CONFIG_E"), ("k/d.c", "CONFIG_F & CONFIG_G", "CONFIG_F & CONFIG_G"), ("k/w32.c", "", "CONFIG_Q"), ("k/w64.c", "", "CONFIG_Q"), ("k/sub/z.c", "CONFIG_SUB", "CONFIG_SUB")],
    ),
    "kb_composites": (
        "x86",
        {
            "Kbuild": "obj-y += k/\n",
            "k/Makefile": "obj-$(CONFIG_N{n}) += comp.o\ncomp-y := one.o deep.o\ncomp-$(CONFIG_T) += two.o\ncomp-objs += both.o\ndeep-y := three.o deeper.o\ndeeper-y := four.o deepest.o\ndeepest-y := five.o\nifdef CONFIG_U\ncomp-y += six.o\nendif\nMORE-y := seven.o\nMORE-$(CONFIG_V) += eight.o\nobj-{m} += mac.o\nmac-objs := $(MORE-y)\nloop-y := loop.o\nobj-y += loop.o both.o\n",
        },
        "k/one.c k/one.S k/two.S k/three.c k/four.c k/five.c k/six.c k/seven.c k/eight.rs k/both.c",
        [("k/one.c", "CONFIG_N{n}", "CONFIG_N{n}"), ("k/two.S", "CONFIG_N{n} & CONFIG_T", "CONFIG_N{n} & CONFIG_T"), ("k/three.c", "CONFIG_N{n}", "CONFIG_N{n}"), ("k/four.c", "CONFIG_N{n}", "CONFIG_N{n}"), ("k/both.c", "", ""), ("k/six.c", "CONFIG_N{n} & CONFIG_U", "CONFIG_N{n} & CONFIG_U"), ("k/seven.c", "", "CONFIG_Q"), ("k/eight.rs", "CONFIG_V", "CONFIG_Q & CONFIG_V")],
    ),
    "kb_two_parents": (
        "x86",
        {"Kbuild": "obj-y += a/ b/\n", "a/Makefile": "obj-$(CONFIG_N{n}) += ../s/x.o ../s/u.o ../s/t/\n", "b/Makefile": "obj-{m} += ../s/x.o\nobj-y += ../s/u.o\nobj-$(CONFIG_B) += ../s/t/\n", "s/t/Makefile": "obj-$(CONFIG_C) += y.o\nobj-$(CONFIG_D) += y.o\n"},
        "s/x.c s/u.c s/t/y.c",
        [("s/x.c", "", "(CONFIG_N{n}) | (CONFIG_Q)"), ("s/u.c", "", ""), ("s/t/y.c", "(CONFIG_N{n} & (CONFIG_C | CONFIG_D)) | (CONFIG_B & (CONFIG_C | CONFIG_D))", "(CONFIG_N{n} & (CONFIG_C | CONFIG_D)) | (CONFIG_B & (CONFIG_C | CONFIG_D))")],
    ),
}


def _map(name: str, s: SparkSession, d: str) -> DataFrame:
    arch, makefiles, others, _ = TREES[name]
    texts = s.createDataFrame([*makefiles.items(), *[(p, "x") for p in others.split()]], "path string, template string")
    of = F.when(F.col("s_acctbal") > 0, "y").otherwise("$(CONFIG_Q)")
    content = F.replace(F.replace("template", F.lit("{n}"), F.col("s_nationkey").cast("string")), F.lit("{m}"), of)
    files = table(s, d, "supplier").crossJoin(F.broadcast(texts)).select(F.col("s_suppkey").cast("string").alias("tree"), "path", content.alias("content"))
    return buildmap.build_map(files, arch)


def _map_sql(name: str) -> str:
    rows = ", ".join(f"('{p}', '{a}', '{b}')" for p, a, b in TREES[name][3])
    return f"SELECT CAST(s_suppkey AS VARCHAR) AS tree, path, replace(CASE WHEN s_acctbal > 0 THEN a ELSE b END, '{{n}}', CAST(s_nationkey AS VARCHAR)) AS condition FROM supplier, (VALUES {rows}) t(path, a, b)"


def _makefiles(s: SparkSession, d: str) -> DataFrame:
    """A makefile for each customer; those of AUTOMOBILE have a block inside that can't be read."""
    block = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "ifeq ($(CC),gcc)\nobj-y += b.o\nelse\nobj-y += c.o\nendif\n").otherwise("")
    text = F.concat(F.lit("# top\nobj-y += k"), F.col("c_nationkey"), F.lit(".o \\\n  more.o # two\nifdef CONFIG_A\n"), block, F.lit("obj-y += a.o\nendif\n"))
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), text.alias("content"))


def logical_lines(s: SparkSession, d: str) -> DataFrame:
    """Comments stripped, continued lines joined."""
    return buildmap.makefile_lines(_makefiles(s, d)).select("path", "line_no", F.regexp_replace("line", " +", " ").alias("line"))


def conditional_depth(s: SparkSession, d: str) -> DataFrame:
    """How many blocks are open, and whether all of them can be read."""
    return buildmap.makefile_lines(_makefiles(s, d)).select("path", "line_no", "depth", "valid")


_LINES_SQL = """l(line_no, line, depth, valid, automobile) AS (VALUES
  (0, 'obj-y += k', 0, true, NULL), (1, 'ifdef CONFIG_A', 1, true, NULL),
  (2, 'ifeq ($(CC),gcc)', 2, false, true), (3, 'obj-y += b.o', 2, false, true), (4, 'else', 2, false, true), (5, 'obj-y += c.o', 2, false, true), (6, 'endif', 1, true, true), (7, 'obj-y += a.o', 1, true, true), (8, 'endif', 0, true, true),
  (2, 'obj-y += a.o', 1, true, false), (3, 'endif', 0, true, false))"""
_LINES_FROM = "FROM customer JOIN l ON coalesce(automobile = (c_mktsegment = 'AUTOMOBILE'), true)"


def arch_resolution(s: SparkSession, d: str) -> DataFrame:
    """What architecture is taken for what is asked for, the banner's, and whether strict; NULL where that is refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = {"arch/x86", "arch/arm", "arch/sparc"}
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    arch = resolve_arch(r.asked, r.banner, there.__contains__, bool(r.strict), ".config")[0]
                except ValueError:
                    arch = None
                rows.append((r.c_custkey, arch, srcarch(arch) if arch else None))
            yield pd.DataFrame(rows, columns=["c_custkey", "arch", "srcarch"])

    pick = lambda c, *names: F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (c % len(names) + 1).cast("int"))
    rows = table(s, d, "customer").select("c_custkey", pick(F.col("c_nationkey"), None, "x86_64", "arm", "sparc64", "mips").alias("asked"), pick(F.col("c_custkey"), None, "i386", "arm").alias("banner"), (F.col("c_acctbal") < 0).alias("strict"))
    return rows.mapInPandas(run, "c_custkey long, arch string, srcarch string")


def object_sources(s: SparkSession, d: str) -> DataFrame:
    """The source that each part's object is made from: of those that exist the first in the order of suffixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"p_partkey": batch["p_partkey"], "source": [source_of(f"{k}.o", set(there.split()).__contains__) for k, there in zip(batch["p_partkey"], batch["there"], strict=True)]})

    k = F.col("p_partkey").cast("string")
    there = F.concat_ws(" ", F.when(F.col("p_size") % 2 == 0, F.concat(k, F.lit(".rs"))), F.when(F.col("p_size") % 3 == 0, F.concat(k, F.lit(".S"))), F.when(F.col("p_size") % 5 == 0, F.concat(k, F.lit(".c"))))
    return table(s, d, "part").select("p_partkey", there.alias("there")).mapInPandas(run, "p_partkey long, source string")


QUERIES = {name: partial(_map, name) for name in TREES} | {"logical_lines": logical_lines, "conditional_depth": conditional_depth, "arch_resolution": arch_resolution, "object_sources": object_sources}
ORACLES = {name: _map_sql(name) for name in TREES} | {
    "logical_lines": f"WITH {_LINES_SQL} SELECT CAST(c_custkey AS VARCHAR) AS path, line_no, CASE WHEN line_no = 0 THEN line || c_nationkey || '.o more.o' ELSE line END AS line {_LINES_FROM}",
    "conditional_depth": f"WITH {_LINES_SQL} SELECT CAST(c_custkey AS VARCHAR) AS path, line_no, depth, valid {_LINES_FROM}",
    "arch_resolution": """WITH c AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 1 THEN 'x86_64' WHEN 2 THEN 'arm' WHEN 3 THEN 'sparc64' WHEN 4 THEN 'mips' END AS asked, CASE c_custkey % 3 WHEN 1 THEN 'i386' WHEN 2 THEN 'arm' END AS banner, c_acctbal < 0 AS strict FROM customer),
      f AS (SELECT *, CASE asked WHEN 'x86_64' THEN 'x86' WHEN 'sparc64' THEN 'sparc' ELSE asked END AS a, CASE banner WHEN 'i386' THEN 'x86' ELSE banner END AS b FROM c),
      t AS (SELECT c_custkey, CASE WHEN a <> b THEN NULL WHEN coalesce(a, b) IN ('x86', 'arm', 'sparc') THEN coalesce(asked, banner) WHEN asked IS NULL AND banner IS NULL AND NOT strict THEN 'x86' END AS arch FROM f)
      SELECT c_custkey, arch, CASE arch WHEN 'x86_64' THEN 'x86' WHEN 'i386' THEN 'x86' WHEN 'sparc64' THEN 'sparc' ELSE arch END AS srcarch FROM t""",
    "object_sources": "SELECT p_partkey, p_partkey || CASE WHEN p_size % 5 = 0 THEN '.c' WHEN p_size % 3 = 0 THEN '.S' WHEN p_size % 2 = 0 THEN '.rs' END AS source FROM part",
}
