"""Source trees to build maps: one task a tree, all trees in parallel (KB1, KB13-14, KB20, SRC8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.functions.makefile import Conditions, Tree, logical_lines

SCHEMA = "tree string, path string, condition string"
LINES = "path string, line_no int, line string, depth int, valid boolean"


def build_map(files: DataFrame, arch: str = "x86") -> DataFrame:
    """(tree, path, condition) from files (tree, path, content); '' is unconditional, no row is unknown.

    Only makefiles' texts are shuffled, other files go as names; a tree's makefiles are a few megabytes.
    """
    makefile = F.col("path").rlike(r"(^|/)(Kbuild|Makefile|Platform|[\w.-]+\.mk|Makefile[\w.-]+|Kbuild[\w.-]+)$")
    slim = files.select("tree", "path", F.when(makefile, F.col("content")).alias("content"))

    def of_tree(rows: pd.DataFrame) -> pd.DataFrame:
        contents = {p: (c if isinstance(c, str) else None) for p, c in zip(rows["path"], rows["content"], strict=True)}
        found = Tree(contents, arch).parse()
        return pd.DataFrame({"tree": rows["tree"].iloc[0], "path": list(found), "condition": list(found.values())}, columns=["tree", "path", "condition"])

    return slim.groupBy("tree").applyInPandas(of_tree, SCHEMA)


def makefile_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line, depth, valid) of the logical lines of makefiles (path, content): how many conditional blocks are open behind each, and whether all can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                stack = Conditions()
                for n, line in enumerate(logical_lines(content or "")):
                    stack.feed(line)
                    rows.append((path, n, line, stack.depth, stack.valid))
            yield pd.DataFrame(rows, columns=["path", "line_no", "line", "depth", "valid"])

    return files.select("path", "content").mapInPandas(run, LINES)
