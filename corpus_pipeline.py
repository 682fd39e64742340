"""A training corpus from ``documents``: quality rules, line dedup, near duplicates, mixing, packing.

Each stage reads what the one before it wrote. All but the last return the columns of documents;
the last returns pieces of packed sequences.

A null or blank text fails the quality rules. Repeated rows are one document to line dedup and near
duplicates. An empty table passes through all stages. Columns beyond those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.llm import jaccard, line_dedup, mixing, packing, quality, shingles
from treelens.llm.common import cut, discard, pick, slices

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars counted again."""
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, and documents that the rules reject."""
    judged = quality.judged(pick(docs, *COLUMNS))
    # None or one of each row, instead of a filter, below which Spark would work the verdict out a second time.
    kept = F.when(F.col("kept"), F.array(F.struct("doc_id", F.col("clean_text").alias("text"), "lang", "source")))
    return _documents(judged.select(F.explode(kept).alias("d")).select("d.*"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand elsewhere before go; a document that they were all of goes with them."""
    rows = line_dedup.dedup_lines(pick(docs, *COLUMNS), keep=("lang", "source"))
    return _documents(rows.where(r"n_chunks_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest doc_id stays."""
    rows = pick(docs, *COLUMNS).withColumn("th", F.xxhash64("text"))
    classes = jaccard.jaccard_classes(rows)
    stay = classes.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("s")).select(F.col("s.doc_id").alias("s_doc"), F.col("s.th").alias("s_th"))
    wordless = classes.where("n_shingles = 0").select(F.col("doc_id").alias("s_doc"), F.col("th").alias("s_th")).distinct()
    keys = stay.unionByName(wordless)
    found = rows.join(keys, rows.doc_id.eqNullSafe(keys.s_doc) & rows.th.eqNullSafe(keys.s_th), "left_semi")
    return _documents(found.dropDuplicates(["doc_id", "th"]))


def _take_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row as often as the mix takes it whole, and its spans of words."""
    for batch in slices(batches):
        at, texts = [], []
        for i, row in enumerate(batch.to_pylist()):
            text = row["text"] or ""
            spans = [(row[f"from_{k}"], row[f"to_{k}"]) for k in (1, 2) if row[f"from_{k}"] < row[f"to_{k}"]]
            found = [text] * row["copies"]
            if spans:
                data = text.encode()
                starts, ends = shingles.word_spans(data)
                found += [text if (a, b) == (0, len(starts)) else data[starts[a] : ends[b - 1]].decode() for a, b in spans]
            at += [i] * len(found)
            texts += found
        taken = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([taken["doc_id"], pa.array(texts, pa.string()), taken["lang"], taken["source"]], names=["doc_id", "text", "lang", "source"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and the spans of words taken beyond that.

    The mix is planned on slim rows; a repeated row's text is met by the plans of all its repeats.
    """
    rows = pick(docs, *COLUMNS).withColumn("th", F.xxhash64("text"))
    plan = mixing.mix(rows, keep=("th", "lang")).where("taken > 0").select(F.col("doc_id").alias("p_doc"), F.col("th").alias("p_th"), F.col("source_name").alias("p_source"), F.col("lang").alias("p_lang"), "copies", "from_1", "to_1", "from_2", "to_2")
    once = rows.dropDuplicates(["doc_id", "th", "source", "lang"])
    met = once.join(plan, once.doc_id.eqNullSafe(plan.p_doc) & (once.th == plan.p_th) & once.source.eqNullSafe(plan.p_source) & once.lang.eqNullSafe(plan.p_lang))
    out = met.select("doc_id", "text", "lang", "source", "copies", "from_1", "to_1", "from_2", "to_2").mapInArrow(_take_words, "doc_id long, text string, lang string, source string")
    return _documents(out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: Tokens, seeded blocks and similarity by hashes aren't SQL's; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
