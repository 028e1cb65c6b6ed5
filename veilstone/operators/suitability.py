"""Whether a collection describes people, and which people it describes.

References ("the analyst who ...") are found with their offsets, merged where they touch, and
told apart by the text around them: in a list of names or a header block they only mention.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_phrase, near_dup_key, spans

#: Nouns for a person's role, and the references made with them (fixed values).
ROLES = (
    "engineer|analyst|developer|administrator|operator|technician|manager|director|officer|deputy|supervisor|contractor|consultant|employee|colleague|clinician|doctor|physician|nurse|patient|caregiver|"
    "defendant|plaintiff|appellant|appellee|petitioner|respondent|witness|claimant|customer|client|tenant|applicant|driver|pilot|controller|teacher|student|reviewer|author|owner|assignee|reporter|caller"
)
REFERENCE = (
    rf"(?iuU)\b(?:the|our|their|a|an|that)\s+(?:\w+\s+){{0,2}}(?:{ROLES})\b"
    r"|\bwho(?:ever|m)?\s+(?:was|is|had|has|were|approved|deployed|signed|filed|handled|noticed|reported|owned)\b"
    r"|\bthe\s+person\s+(?:who|responsible)\b|\bon[- ]call\b"
)
#: Marks of a list: pairs of names, semicolons, header words. The mark of the house differs by profile (fixed values).
NAME_PAIR = r"[A-Z][A-Za-z.'\-]+,\s+[A-Z][A-Za-z.'\-]+"
_HEADS = r"From:|To:|Cc:|Sent:|Subject:|-----Original Message-----|Forwarded by|DL-"
CORPUS_HEADERS = rf"(?i)(?:{_HEADS}|@\w+\.(?:com|org|net))"
#: Characters on either side of a reference or mention, largest gap between merged references, cut-offs (fixed values).
WINDOW, MENTION_WINDOW, GAP, LIST_MARKS = 140, 120, 4, 3
RICH, ABSENT, PROSE_FLOOR = 1.0, 0.05, 0.25
WORD_LIKE = 8.0


def mention_headers(house: str) -> str:
    """Header marks for mentions of people; house is the organisation's mark in addresses."""
    return rf"(?i)(?:{_HEADS}|@{re.escape(house)}|/{re.escape(house)})"


def is_list_context(window: Column, headers: str = CORPUS_HEADERS) -> Column:
    """At least three name pairs, three semicolons or a header mark."""
    pairs = F.size(F.regexp_extract_all(window, F.lit(f"({NAME_PAIR})"), 1)) >= LIST_MARKS
    semicolons = F.length(window) - F.length(F.replace(window, F.lit(";"), F.lit(""))) >= LIST_MARKS
    return pairs | semicolons | window.rlike(headers)


def merged(found: Column, gap: int = GAP) -> Column:
    """Spans that follow each other within `gap` characters as one: array<struct<start, stop>>."""
    return F.aggregate(
        found, F.array().cast("array<struct<start:int,stop:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["start"] - F.element_at(a, -1)["stop"] <= gap),
            F.array_append(F.slice(a, 1, F.size(a) - 1), F.struct(F.element_at(a, -1)["start"].alias("start"), x["stop"].alias("stop"))),
        ).otherwise(F.array_append(a, F.struct(x["start"].alias("start"), x["stop"].alias("stop")))),
    )


def around(text: Column, start: Column, stop: Column, window: int) -> Column:
    begin = F.greatest(F.lit(0), start - window)
    return F.substring(text, begin + 1, stop + window - begin)


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, stop, phrase, listed): every merged reference of every text."""
    rows = df.select(F.col(key), F.col(text).alias("__t")).filter("__t is not null")
    found = rows.select(key, "__t", F.explode(merged(spans(F.col("__t"), REFERENCE))).alias("s"))
    return found.select(key, "s.start", "s.stop", F.substring("__t", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("phrase"), is_list_context(around(F.col("__t"), F.col("s.start"), F.col("s.stop"), WINDOW)).alias("listed"))


def classified(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, prose, listed): how many references of each text stand in prose and in lists;
    counted inside the row, so nothing is shuffled. A null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    flags = F.transform(merged(spans(t, REFERENCE)), lambda s: is_list_context(around(t, s["start"], s["stop"], WINDOW)))
    return df.select(F.col(key), F.size(F.filter(flags, lambda x: ~x)).alias("prose"), F.size(F.filter(flags, lambda x: x)).alias("listed"))


def mentions(df: DataFrame, key: str, text: str, surname: str, house: str) -> DataFrame:
    """(key, descriptive, listed): mentions of a surname in any case, by the text around them."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = spans(t, "(?iuU)" + re.escape(surname))
    flags = F.transform(found, lambda s: is_list_context(around(t, s["start"], s["stop"], MENTION_WINDOW), mention_headers(house)))
    return df.select(F.col(key), F.size(F.filter(flags, lambda x: ~x)).alias("descriptive"), F.size(F.filter(flags, lambda x: x)).alias("listed")).filter("descriptive + listed > 0")


def assess(df: DataFrame, key: str, text: str, has_channel: bool = True) -> DataFrame:
    """One row about a collection: texts, texts with references, their density and share of
    prose, and the verdict. Blank texts do not count."""
    counts = classified(df.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != ""), key, text)
    one = counts.agg(F.count("*").alias("scanned"), F.count_if((F.col("prose") + F.col("listed")) > 0).alias("describing"), F.count_if(F.col("prose") > 0).alias("prose_docs"), F.coalesce(F.sum("prose"), F.lit(0)).alias("prose"), F.coalesce(F.sum("listed"), F.lit(0)).alias("listed"))
    density = F.when(F.col("scanned") > 0, (F.col("prose") + F.col("listed")) / F.col("scanned")).otherwise(0.0)
    share = F.when(F.col("prose") + F.col("listed") > 0, F.col("prose") / (F.col("prose") + F.col("listed"))).otherwise(0.0)
    return one.select("*", F.round(density, 6).alias("density"), F.round(share, 6).alias("prose_share"), band(density).alias("band"), F.size(reasons(density, share, F.lit(has_channel), F.col("prose_docs"))).alias("reasons"))


def band(density: Column) -> Column:
    return F.when(density >= RICH, "rich").when(density < ABSENT, "absent").otherwise("sparse")


def reasons(density: Column, prose_share: Column, has_channel: Column, prose_docs: Column) -> Column:
    """What to know before trusting the band, as a list of sentences."""
    first = F.concat(F.format_string("%.2f references to people per document", density), F.lit("; "), prose_docs.cast("string"), F.lit(" documents hold one in prose."))
    return F.array_compact(F.array(
        first,
        F.when(prose_share < PROSE_FLOOR, F.concat(F.lit("Most references stand in lists or header blocks: only "), F.bround(prose_share * 100, 0).cast("int").cast("string"), F.lit(" % are prose."))),
        F.when(~has_channel, F.lit("No field names people, so results cannot be measured here.")),
        F.lit("A role noun alone is no description; read the phrases before relying on the band."),
    ))


def phrases(df: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """(phrase, uses): the most frequent references in lower case, ties by phrase."""
    return references(df, key, text).groupBy(F.lower("phrase").alias("phrase")).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "phrase").limit(top)


def applicability(band_name: str, found: int) -> str:
    """A note for the reader of a search result."""
    note = {"rich": "This collection describes people often; descriptive search has material.", "sparse": "This collection describes people now and then; read results one by one.", "absent": "This collection hardly describes people; descriptive search finds little here."}[band_name]
    return note + (" An empty result therefore says nothing about whether the person is in it." if found == 0 and band_name != "rich" else "")


def screen(df: DataFrame, text: str, given: str, surname: str, threshold: float = WORD_LIKE, least: int = 4) -> DataFrame:
    """One row (surname_hits, full_hits, ratio, rejected): a surname that stands alone far more
    often than with the first name is an ordinary word; too short a surname is rejected too."""
    one = df.agg(F.count_if(has_phrase(F.col(text), surname)).alias("surname_hits"), F.count_if(has_phrase(F.col(text), f"{given} {surname}")).alias("full_hits"))
    ratio = F.col("surname_hits") / F.greatest(F.col("full_hits"), F.lit(1))
    return one.select("*", F.round(ratio, 6).alias("ratio"), ((ratio >= threshold) | F.lit(len(surname) < least)).alias("rejected"))


def profile(df: DataFrame, key: str, text: str, surname: str, house: str) -> DataFrame:
    """One row (documents, descriptive, list_only, distinct_descriptive) about one surname."""
    found = mentions(df, key, text, surname, house).join(df.select(key, near_dup_key(F.col(text)).alias("__dup")), key)
    return found.agg(F.count("*").alias("documents"), F.count_if(F.col("descriptive") > 0).alias("descriptive"), F.count_if(F.col("descriptive") == 0).alias("list_only"), F.countDistinct(F.when(F.col("descriptive") > 0, F.col("__dup"))).alias("distinct_descriptive"))


def rank_subjects(df: DataFrame, key: str, text: str, subjects: DataFrame, house: str) -> DataFrame:
    """(surname, documents, descriptive, distinct_descriptive) of many surnames in one job,
    best described first. Surnames meet texts by their tokens, an equi-join, not by a scan per
    subject."""
    t = F.coalesce(F.col(text), F.lit(""))
    # words and keys meet the surnames; only texts that hold one are fetched, each once for its surnames
    words = df.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("__w"))
    held = words.join(subjects.select("surname", F.lower("surname").alias("__w")).distinct(), "__w").groupBy(key).agg(F.collect_set("surname").alias("__s"))
    met = df.select(F.col(key), t.alias("__t"), near_dup_key(t).alias("__dup")).join(held, key).select(key, "__t", "__dup", F.explode("__s").alias("surname"))
    parts = F.split(F.lower("__t"), F.concat(F.lit(r"\Q"), F.lower("surname"), F.lit(r"\E")), -1)
    starts = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, p: F.struct((a["at"] + F.length(p) + F.length("surname")).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")), lambda a: a["out"],
    )
    flags = F.transform(starts, lambda s: is_list_context(around(F.col("__t"), s, s + F.length("surname"), MENTION_WINDOW), mention_headers(house)))
    per = met.select("surname", key, "__dup", F.exists(flags, lambda x: ~x).alias("__d"))
    ranked = per.groupBy("surname").agg(F.count("*").alias("documents"), F.count_if("__d").alias("descriptive"), F.countDistinct(F.when(F.col("__d"), F.col("__dup"))).alias("distinct_descriptive"))
    return ranked.orderBy(F.desc("distinct_descriptive"), "surname")
