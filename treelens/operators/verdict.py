"""Findings, build map and configuration to verdicts (AGG1, FLT10-12, JN3-4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelens.functions import condition

_JUDGED = T.StructType([T.StructField("logic", T.StringType()), T.StructField("affected", T.BooleanType())])


def any_affected(files: DataFrame) -> DataFrame:
    """Per rule the OR of its files' verdicts that are known; NULL if none is."""
    return files.groupBy("rule_id").agg(F.bool_or("affected").alias("affected"))


def strict(rules: DataFrame) -> DataFrame:
    """Drop rules that are known not to be affected; unknown ones stay."""
    return rules.where(~F.col("affected").eqNullSafe(F.lit(False)))


def file_verdicts(findings: DataFrame, build_map: DataFrame, srcarch: str, config: dict[str, bool] | None) -> DataFrame:
    """rule_id, path, logic, mapped, affected, severity of each finding (rule_id, path).

    The formulas are simplified once per distinct condition and side of the arch rule, then joined back.
    """
    met = findings.join(build_map.withColumnRenamed("condition", "raw"), "path", "left")
    foreign = F.col("path").startswith("arch/") & ~F.col("path").startswith(f"arch/{srcarch}/")
    met = met.withColumn("foreign", foreign)

    @F.pandas_udf(_JUDGED)
    def judge(raw: pd.Series, is_foreign: pd.Series) -> pd.DataFrame:
        told = [condition.evaluate(x if isinstance(x, str) else None, "arch/-/x" if f else "x", srcarch, config) for x, f in zip(raw, is_foreign, strict=True)]
        return pd.DataFrame(told, columns=["logic", "affected"], dtype=object)

    told = met.select(F.col("raw").alias("t_raw"), F.col("foreign").alias("t_foreign")).distinct().withColumn("j", judge("t_raw", "t_foreign"))
    out = met.join(told, F.col("raw").eqNullSafe(F.col("t_raw")) & (F.col("foreign") == F.col("t_foreign")))
    mapped = F.col("raw").isNotNull()
    severity = F.when(mapped, "").when(F.col("path").rlike(r"\.(c|S|s|rs)$"), "warning").otherwise("debug")
    return out.select("rule_id", "path", "j.logic", mapped.alias("mapped"), "j.affected", severity.alias("severity"))
