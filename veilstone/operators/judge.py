"""Keeping judged documents by confidence, and judging by rule where nobody else judges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence needed in each mode; other names mean the last one (fixed values).
MODES = {"strict": 0.88, "balanced": 0.75, "high_recall": 0.60}

Judge = Callable[[DataFrame], DataFrame]


def threshold_for(mode: str | None) -> float:
    return MODES.get(mode or "high_recall", MODES["high_recall"])


def filter_flagged(evaluations: DataFrame, mode: str | None = "high_recall", candidates: DataFrame | None = None) -> DataFrame:
    """The evaluations that are identifiable and confident enough for the mode.

    A confidence that is no number counts as 0. Null and empty snippets are dropped. With
    candidates (doc_id, index, text, timestamp), columns the evaluations lack are filled in
    from the last candidate of the same doc_id (by timestamp, then text).
    """
    confidence = F.coalesce(F.expr("try_cast(confidence_score as double)"), F.lit(0.0))
    kept = evaluations.withColumn("confidence_score", confidence).filter(F.coalesce(F.col("is_identifiable"), F.lit(False)) & (F.col("confidence_score") >= threshold_for(mode)))
    if "identifying_snippets" in kept.columns:
        kept = kept.withColumn("identifying_snippets", F.filter("identifying_snippets", lambda x: x.isNotNull() & (x != "")))
    if candidates is not None:
        missing = [c for c in ("index", "text", "timestamp") if c not in kept.columns and c in candidates.columns]
        if missing:
            last = candidates.groupBy("doc_id").agg(F.max(F.struct(*[c for c in ("timestamp", "text", "index") if c in candidates.columns])).alias("__c"))
            kept = kept.join(last, "doc_id", "left").select(*kept.columns, *(F.col(f"__c.{c}").alias(c) for c in missing))
    return kept


def flagged_at(evaluations: DataFrame, threshold: float) -> DataFrame:
    """(doc_id) of the different documents flagged at a threshold; a null confidence is 0."""
    return evaluations.filter(F.coalesce(F.col("is_identifiable"), F.lit(False)) & (F.coalesce(F.col("confidence_score"), F.lit(0.0)) >= threshold)).select("doc_id").distinct()


def without(evaluations: DataFrame, ids: DataFrame) -> DataFrame:
    """The evaluations whose doc_id is not in ids."""
    return evaluations.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def rule_judge(candidates: DataFrame) -> DataFrame:
    """A deterministic judge for tests and dry runs: identifiable if the text describes a
    person in prose, with a confidence by the number of such references."""
    from .suitability import classified

    counts = classified(candidates, "doc_id", "text")
    score = F.least(F.lit(0.95), 0.5 + 0.15 * F.col("prose"))
    return counts.select("doc_id", (F.col("prose") > 0).alias("is_identifiable"), F.when(F.col("prose") > 0, score).otherwise(0.0).alias("confidence_score"))


def evaluate(candidates: DataFrame, judge: Judge = rule_judge) -> DataFrame:
    """Evaluations of candidates by any judge; a candidate without verdict is not identifiable."""
    verdicts = judge(candidates)
    joined = candidates.select("doc_id").join(verdicts, "doc_id", "left")
    return joined.withColumn("is_identifiable", F.coalesce("is_identifiable", F.lit(False))).withColumn("confidence_score", F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0)))
