"""The corpus operators' queries, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from treelens.llm import fingerprints, jaccard, licenses, line_dedup, mixing, packing, quality, secrets, sharding, token_files


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict:
    return {
        "op1_sharding": lambda s, d: sharding.shard_documents(_documents(s, d), 40),
        "op2_jaccard_join": lambda s, d: jaccard.jaccard_join(_documents(s, d)),
        "op3_line_dedup": lambda s, d: line_dedup.dedup_lines(_documents(s, d)),
        "op4_token_files": lambda s, d: token_files.token_files(_documents(s, d), tokenizer_path()),
        "op5_secret_scan": lambda s, d: secrets.scan_secrets(_documents(s, d), tokenizer_path()),
        "op6_fingerprints": lambda s, d: fingerprints.edited_fingerprints(_documents(s, d)),
        "op7_packing": lambda s, d: packing.pack_documents(_documents(s, d), tokenizer_path()),
        "op8_license_scan": lambda s, d: licenses.license_scan(licenses.document_paths(_documents(s, d))),
        "op9_mixing": lambda s, d: mixing.mix(_documents(s, d)),
        "op10_quality_rules": lambda s, d: quality.quality_rules(_documents(s, d)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
