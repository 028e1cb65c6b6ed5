"""A corpus without a person's names, and the gate that proves it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.personal import phone_signals
from ..functions.text import is_opaque_id, masked_id

#: Columns a masked corpus must not carry, and how often a marker must occur against the positives (fixed values).
FORBIDDEN = ("from", "to", "cc", "custodian", "folder", "message_id", "subject")
DILUTION = 20
NAMESPACE = "veilstone/masked/v1"


def hits(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def mask(text: Column, pattern: str, replacement: str = "") -> Column:
    """The text with every variant replaced. If variants were removed altogether, white space
    runs of two or more become one blank and the text is trimmed."""
    out = F.regexp_replace(text, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))
    if replacement == "":
        out = F.when(hits(text, pattern) > 0, F.trim(F.regexp_replace(out, r"(?U)\s{2,}", " "))).otherwise(out)
    return out


def find_variants(text: Column, pattern: str) -> Column:
    """The variants a text holds as it spells them, once each in any case, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    seen = F.aggregate(found, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))
    return F.coalesce(seen, F.array().cast("array<string>"))


def alias_failures(names: list[str] | None, labels: list[str] | None) -> list[str]:
    """Why an alias set is no basis for masking; empty if it is one or if there is none."""
    if names is None:
        return []
    out = [] if names else ["the alias set has no names"]
    return out if labels else [*out, "no variant belongs to the subject alone"]


def masked_corpus(docs: DataFrame, pattern: str, label_pattern: str, key: str = "_id", text: str = "message", stamp: str = "ts", replacement: str = "", namespace: str = NAMESPACE) -> DataFrame:
    """(_id, message, ts, original_id, hits, label_hits): opaque id, masked text, how many
    variants were masked, and how many different label variants the text held before."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        masked_id(F.col(key), namespace).alias("_id"), mask(t, pattern, replacement).alias("message"), F.col(stamp).alias("ts"),
        F.col(key).alias("original_id"), hits(t, pattern).alias("hits"), F.size(find_variants(t, label_pattern)).alias("label_hits"),
    )


def positives(corpus: DataFrame) -> DataFrame:
    """(doc_id, original_id, label_hits) of the documents that held a label variant."""
    return corpus.filter("label_hits > 0").select(F.col("_id").alias("doc_id"), "original_id", F.col("label_hits").cast("long").alias("label_hits"))


def masking_stats(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("scanned"), F.count_if(F.col("hits") > 0).alias("masked"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("total_hits"), F.count_if(F.col("label_hits") > 0).alias("positives"))


def audit(masked: DataFrame, pattern: str, phone_policy: str = "identification", marker: str = "", positive_count: int = 0) -> DataFrame:
    """One row (passed, failures, documents, survivors, readable_ids, forbidden, phone_signals,
    marker_documents): five checks on the masked table alone. The names themselves are never
    reported. phone_policy "leakage" fails on telephone numbers, "identification" only counts them; others are refused.
    """
    if phone_policy not in ("identification", "leakage"):
        raise ValueError(f"unknown phone policy: {phone_policy}")
    forbidden = [c for c in FORBIDDEN if c in masked.columns]
    filled = [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")) for c in forbidden]
    one = masked.agg(
        F.count("*").alias("documents"), F.count_if(hits(F.col("message"), pattern) > 0).alias("survivors"), F.count_if(~F.coalesce(is_opaque_id(F.col("_id")), F.lit(False))).alias("readable_ids"),
        (sum(filled[1:], filled[0]) if filled else F.lit(0)).cast("long").alias("forbidden"), F.coalesce(F.sum(phone_signals(F.col("message"))), F.lit(0)).cast("long").alias("phone_signals"),
        (F.count_if(F.contains("message", F.lit(marker))) if marker else F.lit(0)).cast("long").alias("marker_documents"),
    )
    thin = (F.col("marker_documents") < DILUTION * positive_count) if marker and positive_count else F.lit(False)
    failures = F.array_compact(F.array(
        F.when(F.col("survivors") > 0, F.lit("variants survive")), F.when(F.col("readable_ids") > 0, F.lit("ids are readable")), F.when(F.col("forbidden") > 0, F.lit("forbidden fields are filled")),
        F.when((F.col("phone_signals") > 0) & F.lit(phone_policy == "leakage"), F.lit("telephone numbers remain")), F.when(thin, F.lit("the marker gives positives away")),
    ))
    return one.select((F.size(failures) == 0).alias("passed"), failures.alias("failures"), "*")


def loose_report(masked: DataFrame, names: list[str], text: str = "message") -> DataFrame:
    """(documents, hits): documents that hold one of the names anywhere, inside words too, and how
    often. The gate shares the masker's idea of a word; this does not, so it finds too much and
    is a report only. Names of fewer than four characters are left out."""
    ordered = sorted({n for n in names if len(n) >= 4}, key=lambda v: (-len(v), v))
    if not ordered:
        return masked.agg(F.lit(0).cast("bigint").alias("documents"), F.lit(0).cast("bigint").alias("hits"))
    loose = "(?iu)" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\\1", v) for v in ordered)
    n = hits(F.col(text), loose)
    return masked.agg(F.count_if(n > 0).alias("documents"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("hits"))


def verify_positives(found: DataFrame, source: DataFrame, label_pattern: str, key: str = "_id", text: str = "message", count: int = 5) -> DataFrame:
    """(checked, confirmed): the first positives looked up in the source again."""
    few = found.orderBy("doc_id").limit(count)
    rows = few.join(source.select(F.col(key).alias("original_id"), F.col(text).alias("__t")), "original_id")
    return rows.agg(F.count("*").alias("checked"), F.count_if(hits(F.col("__t"), label_pattern) > 0).alias("confirmed"))


class NotScorable(Exception):
    """A masked corpus that must not be scored."""


def assert_scorable(labels: dict, index: str | None) -> None:
    """Refuse a wrong index, a label file without index and one whose audit failed."""
    if not labels.get("masked_index") or not index:
        raise NotScorable("the label file or the call names no masked index")
    if labels["masked_index"] != index:
        raise NotScorable("the label file belongs to another index")
    if not labels.get("audit", {}).get("passed"):
        raise NotScorable("the audit of the masked index failed")
