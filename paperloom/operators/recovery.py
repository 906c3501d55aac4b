"""Amounts filled from running text, provenance of evidence and the state of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.blanks import is_unrecovered
from paperloom.functions.numbers import stated_amounts


def recovered(df: DataFrame, text: str, totals: list[str], fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """``df`` with blank amounts filled from a text, where all of ``totals`` are blank, and ``recovered`` naming them.

    ``fields`` has {column: (found amount, the amount used where that is missing)}.
    """
    blank = F.lit(True)
    for t in totals:
        blank = blank & is_unrecovered(F.col(t))
    found = df.withColumn("_found", stated_amounts(F.col(text)))
    filled, names = [], []
    for column, (source, other) in fields.items():
        value = F.coalesce(F.col(f"_found.{source}"), F.col(f"_found.{other}")) if other else F.col(f"_found.{source}")
        fill = blank & is_unrecovered(F.col(column)) & value.isNotNull()
        filled.append((column, F.when(fill, value).otherwise(F.col(column).cast("double"))))
        names.append(F.when(fill, F.lit(column)))
    out = found.withColumn("recovered", F.filter(F.array(*names), lambda x: x.isNotNull()))
    return out.withColumns(dict(filled)).drop("_found")


def provenance(source: Column) -> Column:
    """Whether a text is evidence of its own: a text layer or recognition is, the model's own transcript isn't."""
    return F.when(source.isin("text_layer", "ocr"), "independent").when(source == "vlm_transcription", "dependent").otherwise("none")


def combined_quality(score: Column, audit_error: Column, low_resolution: Column, unproven: Column) -> Column:
    """struct(score, status): 10 off for low resolution, 5 for each value the text doesn't bear out, 15 at most."""
    less = F.when(low_resolution, 10.0).otherwise(0.0) + F.least(unproven * 5.0, F.lit(15.0))
    left = F.greatest(F.lit(0.0), score - less)
    status = F.when(audit_error, "needs_attention").when(left >= 85, "high").when(left >= 70, "satisfactory").otherwise("needs_attention")
    return F.struct(left.alias("score"), status.alias("status"))


def document_status(failed: Column, error: Column) -> Column:
    return F.when(failed, "FAILED").when(error, "NEEDS_REVIEW").otherwise("COMPLETED")


def needs_review(status: Column, verdict: Column, blocking: list[str]) -> Column:
    """Failed records and those of a blocking verdict; a missing verdict is none."""
    return F.coalesce(F.upper(status) == "FAILED", F.lit(False)) | F.coalesce(verdict.isin(*blocking), F.lit(False))


def escalations(df: DataFrame, escalated: str, kept: str) -> DataFrame:
    """How many extracted records took a second run, and in how many the first answer was kept."""
    done = df.where(F.coalesce(F.col("status") != "FAILED", F.lit(True)))
    out = done.agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col(escalated)).alias("escalated"), F.count_if(F.col(kept)).alias("kept_first"))
    rate = F.when(F.col("extracted") > 0, F.bround(F.col("escalated") * 100.0 / F.col("extracted"), 1)).otherwise(0.0)
    return out.withColumn("second_runs", F.col("escalated") + F.col("kept_first")).withColumn("escalation_rate", rate)
