"""License scans: TF-IDF cosine to templates, then inheritance along directories.

Every line that speaks of a licence is a header to be told; it is held against the templates as a
sparse vector of its terms, weighed by how rare they are over all such lines and templates. So are
windows of terms around the cue in the stretch of lines that it stands in, for notices that wrap or stand in
prose, and whole stretches; whole stretches, and whole texts of files named like licences or dense with
such lines, are also held against the licences' full texts. The most similar template above a threshold is
the unit's licence, the best unit's is the file's. A file that is little else than such lines, or whose
whole text is a licence's, is a licence file and speaks for its directory: a file
without a licence of its own takes that of the nearest directory above it that has one, by joining the
paths of its ancestors.

DataFrame functions only. Defined results: null texts and texts without a licence line have no licence
of their own; long texts and lines are judged whole; null paths have no directory and inherit nothing; ties go to the more similar, then to
the first template by name, and for a directory to the first path; repeated rows are files of their own
with equal results; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.llm.common import cut, discard, join_groups, pick

#: Notices as their licences ask them to be given.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted; neither the name of the copyright holder may be used to endorse. Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy.",
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "Released into the public domain under the Unlicense.",
}
#: Templates that stand for another's licence.
ALIASES = {"MIT-notice": "MIT"}
_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}."
#: Headers of files: each as (licence, text).
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", _GNU.format("program", "General Public License", "2")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", _GNU.format("program", "General Public License", "2").split(" This program is distributed")[0]),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3").split(" This program is distributed")[0]),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3")),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
THRESHOLD, FULL_THRESHOLD, OWN_PERCENT = 0.6, 0.8, 50
#: Characters of templates up to which their terms are sent to all executors; beyond, they are joined by shuffle.
BROADCAST_CHARS = 8_000_000
#: Terms of a window, each a quarter of itself after the one before; cue lines that a dense file has at least, and their percentage of its lines.
WINDOWS, DENSE_LINES, DENSE_PERCENT = (8, 16, 32, 64), 3, 10
_NAMED = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)[^/]*$"
#: Between two stretches: a line without a letter or digit.
_APART = r"\n[^A-Za-z0-9\n]*(?=\n)"
_CUE = r"(?i)licen[cs]e|spdx|copyright|permission is hereby|redistribution and use|public domain|creative commons|\bcc(?: by|0)\b"
#: A term that some match of _CUE in a line of terms holds.
_CUE_TERM = r"licen[cs]e|spdx|copyright|permission|redistribution|public|creative|(?:^|[.-])cc(?:0|$)"
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TERM})"))


def _notices(templates: dict[str, str]) -> list[tuple[str, str, str]]:
    """(template, licence, text) of the one-line notices, the headers and the SPDX lines."""
    out = [(name, ALIASES.get(name, name), text) for name, text in sorted(templates.items())]
    known = {licence for _, licence, _ in out}
    out += [(f"{licence}-header-{i}", licence, text) for i, (licence, text) in enumerate(HEADERS) if licence in known]
    return out + [(f"{x}-spdx{end}", x, f"SPDX-License-Identifier: {x}{end}") for x in sorted(known) for end in ("", "-only", "-or-later") if not end or "GPL" in x]


def _full_texts(licences: set[str]) -> list[tuple[str, str, str]]:
    """(template, licence, text) of the licences' full texts."""
    found = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f"{p.stem}-text", p.stem, p.read_text()) for p in found if p.stem in licences]


def _windows(terms: Column) -> Column:
    """The windows of a stretch's terms that hold a cue: each starts a multiple of a quarter of its length from the first term, or ends with the last."""

    def over(places: Column, n: int) -> Column:
        step, last = n // 4, F.size(terms) - n

        def starts(p: Column) -> Column:
            first = F.greatest(F.ceil((p - n + 1) / F.lit(float(step))).cast("int"), F.lit(0))
            every = F.transform(F.sequence(first, F.floor(p / F.lit(float(step))).cast("int")), lambda k: F.least(k * step, last))
            return F.when(p >= last, F.array_append(every, last)).otherwise(every)

        found = F.array_distinct(F.flatten(F.transform(places, starts)))
        return F.when(last > 0, F.transform(found, lambda i: F.slice(terms, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(terms) - 1, F.lit(0))), lambda i: F.coalesce(F.get(terms, i).rlike(_CUE_TERM), F.lit(False)))
    each = F.element_at(F.transform(F.array(places), lambda at: F.concat(*[over(at, n) for n in WINDOWS])), 1)
    return F.filter(F.array_distinct(each), lambda w: F.array_join(w, " ").rlike(_CUE))


def _promising(units: DataFrame, by: list[str], weights: DataFrame, least: float) -> DataFrame:
    """by, term, tf of the units (by, terms) that may be similar enough to a template.

    ``weights`` has the idf of the templates' terms. No other term weighs less than its number, and only the templates' terms count
    for a template, so a unit whose cosine can't reach ``least`` is told without looking up its other terms.
    """
    counted = units.repartition(*by).select(*by, F.explode("terms").alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("tf"))
    square = (F.col("tf") * F.coalesce("weight", F.lit(1.0))) ** 2
    summed = counted.join(weights.select("term", F.col("idf").alias("weight")), "term", "left").groupBy(*by)
    told = summed.agg(F.collect_list(F.struct("term", "tf")).alias("v"), F.sum(F.when(F.col("weight").isNotNull(), square).otherwise(0.0)).alias("known"), F.sum(square).alias("all"))
    return told.where(F.col("known") >= F.col("all") * (least * least - 1e-9)).select(*by, F.explode("v").alias("v")).select(*by, "v.term", "v.tf")


def _scores(vectors: DataFrame, by: list[str], known: DataFrame, idf: DataFrame, unseen: float, threshold: float, small: bool) -> DataFrame:
    """by, template, score of the units' terms (by, term, tf) that are similar enough to a template, and whether they hold all its numbers.

    A term without idf weighs ``unseen``; ``small`` says that the templates have few terms. Without the numbers, a part of a notice is as near to one version of a licence as to another.
    """
    weight = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    vectors = vectors.join(idf, "term", "left").withColumn("w", weight)
    norms = vectors.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighed = _counts(known, ["template", "licence"]).join(idf, "term", "left").withColumn("w", weight)
    number = F.col("term").rlike("[0-9]").cast("int")
    template_norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_norm"), F.sum(number).alias("numbers"))
    sparse = weighed.join(template_norms, "template").select("template", "licence", "numbers", "term", (F.col("w") / F.col("template_norm")).alias("tw"))
    if small:  # equal terms of many units meet their templates where they are
        sparse = F.broadcast(sparse)
    dots = vectors.join(sparse, "term").groupBy(*by, "template", "licence", "numbers").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.sum(number).alias("held"))
    return dots.join(norms, by).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold).withColumn("numbered", F.col("held") == F.col("numbers"))


def _best(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.min_by(F.struct("licence", "score"), F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))


def _counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, F.explode("terms").alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("tf"))


def license_scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, path, n_license_lines, own, own_score, licence, inherited_from of every file."""
    spark, templates = files.sparkSession, templates or TEMPLATES
    rows = pick(files, key, path, text).toDF("key", "path", "text")
    found = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda line: line.rlike(_CUE))
    rows = rows.select("*", found.alias("lines"))  # by itself, so that it is worked out once a row
    any_line = F.size("lines") > 0
    stretches = F.when(any_line, F.filter(F.split(F.col("text"), _APART), lambda x: x.rlike(_CUE))).otherwise(F.array().cast("array<string>"))
    dense = (F.size("lines") >= DENSE_LINES) & (F.size("lines") * 100 >= F.size(F.split("text", "\n")) * DENSE_PERCENT)
    whole = F.when(F.coalesce(F.col("path").rlike(_NAMED), F.lit(False)) | dense, F.col("text"))
    # One slim row a file: its licence lines and their stretches alone, how many of its words they hold, and the whole text of what looks like a licence.
    slim = cut(rows.select(F.monotonically_increasing_id().alias("file"), "key", "path", "lines", F.coalesce(F.when(any_line, F.size(_terms(F.col("text")))), F.lit(0)).alias("n_terms"), stretches.alias("stretches"), whole.alias("whole")), "license-lines")
    lines = slim.select("file", F.posexplode("lines").alias("at", "line")).select("file", "at", _terms(F.col("line")).alias("terms"), F.lit(True).alias("line"))
    runs = slim.select("file", F.posexplode("stretches").alias("at", "run")).select("file", "at", _terms(F.col("run")).alias("terms"))
    views = runs.select("file", "at", F.explode(_windows(F.col("terms"))).alias("terms"), F.lit(False).alias("line"))
    units = cut(lines.unionByName(views).withColumn("bag", F.xxhash64("terms")), "license-units")
    # Equal lines are judged once: they are many files' headers word for word.
    bags = cut(units.groupBy("bag", "terms").agg(F.count(F.when(F.col("line"), 1)).alias("times")).select(F.monotonically_increasing_id().alias("id"), "*"), "license-bags")
    notices = _notices(templates)
    texts = _full_texts({x for _, x, _ in notices})
    small = sum(len(line) for *_, line in [*notices, *texts]) <= BROADCAST_CHARS
    known = spark.createDataFrame(notices, "template string, licence string, line string").select("template", "licence", _terms(F.col("line")).alias("terms"))
    full = spark.createDataFrame(texts, "template string, licence string, line string").select("template", "licence", _terms(F.col("line")).alias("terms"))
    # Document frequencies over all lines and all notices.
    of_lines = bags.where("times > 0").select("times", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("times").alias("n"))
    of_templates = known.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = (bags.agg(F.sum("times")).first()[0] or 0) + len(notices)
    idf = cut(of_lines.unionByName(of_templates).groupBy("term").agg((F.ln(F.lit(float(total + 1)) / (F.sum("n") + 1)) + 1).alias("idf")), "license-idf")
    unseen = math.log(total + 1) + 1
    weights = cut(known.unionByName(full).select(F.explode("terms").alias("term")).distinct().join(idf, "term", "left").select("term", F.coalesce("idf", F.lit(unseen)).alias("idf")), "license-weights")
    if small:
        weights = F.broadcast(weights)
    vectors = cut(_promising(bags.select("id", "terms"), ["id"], weights, threshold), "license-vectors")
    of_bags = cut(_scores(vectors, ["id"], known, idf, unseen, threshold, small), "license-scores")
    best = _best(of_bags, ["id"]).withColumn("line", F.lit(True)).unionByName(_best(of_bags.where("numbered"), ["id"]).withColumn("line", F.lit(False)))
    best = best.join(bags.select("id", "bag", "terms"), "id").drop("id")
    judged = units.join(best, ["bag", "terms", "line"]).select("file", "at", F.when(F.col("line"), F.size("terms")).otherwise(0).alias("n"), F.lit(False).alias("whole"), "b.licence", "b.score")
    wholes = runs.withColumn("whole", F.lit(False)).unionByName(slim.where("whole is not null").select("file", F.lit(-1).alias("at"), _terms(F.col("whole")).alias("terms"), F.lit(True).alias("whole")))
    by = ["file", "at", "whole"]
    long_vectors = cut(_promising(wholes, by, weights, min(threshold, FULL_THRESHOLD)), "license-texts")
    scored = _scores(long_vectors, by, known, idf, unseen, threshold, small).where("numbered").unionByName(_scores(long_vectors, by, full, idf, unseen, FULL_THRESHOLD, small))
    judged = judged.unionByName(_best(scored, by).select("file", "at", F.lit(0).alias("n"), "whole", "b.licence", "b.score"))
    own = judged.groupBy("file").agg(F.max_by(F.struct("licence", "score"), F.struct("score", (-F.col("at")).alias("at"), F.col("licence"))).alias("b"), F.sum("n").alias("n_license_terms"), F.max(F.when(F.col("whole"), F.struct("score", "licence"))).alias("told"))
    # A whole text that matches tells the licence before any line in it does.
    own = own.select("file", F.coalesce("told.licence", "b.licence").alias("licence"), F.coalesce("told.score", "b.score").alias("score"), "n_license_terms", F.col("told").isNotNull().alias("whole_matches"))
    speaks = F.coalesce(F.col("whole_matches") | (F.col("n_license_terms") * 100 >= F.col("n_terms") * OWN_PERCENT), F.lit(False))
    told = cut(slim.drop("whole").join(own, "file", "left").select("file", "key", "path", F.size("lines").cast("long").alias("n_license_lines"), F.col("licence").alias("own"), F.col("score").alias("own_score"), (speaks & F.col("licence").isNotNull()).alias("speaks")), "license-files")
    discard(slim, units, bags, idf, vectors, of_bags, long_vectors)
    return _inherit(told).select(F.col("key").alias(key), "path", "n_license_lines", "own", "own_score", F.coalesce("own", "from.licence").alias("licence"), F.when(F.col("own").isNull(), F.col("from.dir")).alias("inherited_from"))


def _ancestors(path: Column) -> Column:
    """The directories above a path, the root as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _inherit(told: DataFrame) -> DataFrame:
    """Add ``from`` (dir, licence) of the nearest directory above each path whose licence file speaks for it.

    Directories, not files, meet their ancestors: files of one directory share the answer.
    """
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    placed = told.withColumn("dir", parent)
    speakers = placed.where("speaks and dir is not null").groupBy("dir").agg(F.min_by("own", F.struct((-F.col("own_score")).alias("s"), "path")).alias("licence"))
    dirs = placed.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(F.array_append(_ancestors(F.col("dir")), F.col("dir")))).alias("above"))
    nearest = dirs.join(speakers.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct(F.col("above").alias("dir"), "licence"), F.length("above")).alias("from"))
    files = placed.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    return join_groups(placed, cut(nearest.join(files, "dir"), "license-dirs"), "dir", "n", "left")


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files of a tree: source/lang/doc_id."""
    rows = pick(docs, "doc_id", "source", "lang", "text")
    return rows.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_"))))
