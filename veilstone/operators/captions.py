"""Parties of case captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First words of institutions, and words that make a party an organisation wherever they stand (fixed values).
INSTITUTIONS = (
    "united", "state", "states", "people", "commonwealth", "city", "county", "town", "village", "township", "department", "board", "bureau", "district", "court", "commissioner", "secretary",
    "director", "warden", "sheriff", "estate", "matter", "university", "hospital", "school", "administration", "division", "agency", "republic", "government",
)
CORPORATE = (
    "inc", "llc", "llp", "ltd", "corp", "corporation", "company", "companies", "co", "bank", "insurance", "holdings", "associates", "partners", "trust", "systems", "group", "enterprises",
    "industries", "services", "association", "railroad", "railway", "airlines", "motors", "foundation",
)
#: Roles and offices that are no part of a party's name, generational and professional suffixes (fixed values).
_ROLE = (
    r"(?i)[,;]?\s*\b(?:defendants?|plaintiffs?|appell(?:ants?|ees?)|petitioners?|respondents?|movants?|intervenors?|claimants?|garnishees?|relators?|cross[-\s]?\w+|et\s+al|et\s+ux|pro\s+se|individually|d/b/a|a/k/a|"
    r"attorney\s+general|solicitor\s+general|district\s+attorney|husband|wife|minor\s+child|next\s+friend|guardian\s+ad\s+litem|in\s+his\s+\w+\s+capacity|in\s+her\s+\w+\s+capacity)\b\.?"
)
_SUFFIX = r"(?i)[,\s]+\b(?:jr|sr|ii|iii|iv|esq|md|phd)\b\.?$"
MIN_SURNAME = 4
_EDGE = r"^[ ,;.\-]+|[ ,;.\-]+$"


def _tidy(party: Column) -> Column:
    """A party without roles, article and suffix."""
    p = F.regexp_replace(F.regexp_replace(party, _ROLE, " "), r"[\s\-]{2,}", " ")
    p = F.regexp_replace(F.regexp_replace(p, _EDGE, ""), r"(?i)^(?:the|a|an)\s+", "")
    return F.regexp_replace(F.regexp_replace(p, _SUFFIX, ""), _EDGE, "")


def parties(caption: Column) -> Column:
    """The parties of a caption in order: cut at "v." and "ex rel.", prefixes such as "In re"
    and roles removed. A null or blank caption has none."""
    flat = F.trim(F.regexp_replace(caption, r"\s+", " "))
    flat = F.regexp_replace(flat, r"(?i)^\s*(?:in\s+re|ex\s+parte|matter\s+of|estate\s+of)\b[:\s]*", "")
    pieces = F.split(flat, r"(?i)\s+vs?\.?\s+|[,;]?\s*\bex\s+rel(?:atione)?\.?\s+", -1)
    return F.coalesce(F.filter(F.transform(pieces, _tidy), lambda p: p != ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[\s,]+", -1), lambda w: F.regexp_replace(w, r"^[.,;'\"]+|[.,;'\"]+$", ""))
    return F.filter(parts, lambda w: w != "")


def _place(tokens: Column) -> Column:
    """1-based place of the first institutional word, 0 if there is none."""
    marks = F.transform(tokens, lambda t: F.lower(t).isin(*INSTITUTIONS))
    return F.coalesce(F.array_position(marks, F.lit(True)).cast("int"), F.lit(0))


def person_words(party: Column) -> Column:
    """The words of a party that name a person. Segments between commas are read until one
    names an institution; in the first segment at least two words must stand before it."""
    segments = F.filter(F.transform(F.split(party, ",", -1), lambda x: F.trim(x)), lambda s: s != "")
    step = lambda a, s: F.when(a["done"], a).otherwise(_step(a, words(s)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))
    return F.aggregate(segments, start, step, lambda a: a["kept"])


def _step(a: Column, tokens: Column) -> Column:
    at = _place(tokens)
    head = F.when((F.size(a["kept"]) == 0) & (at >= 3), F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(a["kept"])
    return F.when(at > 0, F.struct(head.alias("kept"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(a["kept"], tokens).alias("kept"), F.lit(False).alias("done")))


def is_organisation(party: Column) -> Column:
    return F.exists(words(party), lambda w: F.lower(w).isin(*CORPORATE)) | (F.size(person_words(party)) == 0)


def surname(party: Column) -> Column:
    """The last word of a person's name if it can be a surname, else ''."""
    last = F.try_element_at(person_words(party), F.lit(-1))
    fine = (F.length(last) >= MIN_SURNAME) & ~F.lower(last).isin(*INSTITUTIONS, *CORPORATE) & last.rlike(r"^[A-Za-z][A-Za-z'\-]+$")
    return F.when(~is_organisation(party) & F.coalesce(fine, F.lit(False)), last).otherwise("")


def caption_parties(df: DataFrame, key: str, caption: str) -> DataFrame:
    """(key, pos, party, organisation, surname, given): one row per party of every caption."""
    rows = df.select(F.col(key), F.posexplode(parties(F.col(caption))).alias("pos", "party"))
    first = F.get(person_words(F.col("party")), 0)
    given = F.when(~is_organisation(F.col("party")) & (F.size(person_words(F.col("party"))) >= 2) & first.rlike("^[A-Z][a-z]{2,}$"), first).otherwise("")
    return rows.select(key, "pos", "party", is_organisation(F.col("party")).alias("organisation"), surname(F.col("party")).alias("surname"), given.alias("given"))


def captions_of(clusters: DataFrame, key: str = "cluster_id", names: tuple[str, ...] = ("case_name_full", "case_name", "case_name_short")) -> DataFrame:
    """(key, caption): the first filled name of each cluster; of repeated rows the greatest
    caption counts. Clusters without any name are left out."""
    caption = F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in names))
    return clusters.groupBy(key).agg(F.max(caption).alias("caption")).filter("caption is not null")
