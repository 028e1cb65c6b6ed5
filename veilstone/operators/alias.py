"""All the forms a person is written in, who owns which form, and the pattern that finds them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 3


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"^['\"]+|['\"]+$", "")


def _first(c: Column) -> Column:
    return F.substring(c, 1, 1)


def name_forms(variant: Column) -> Column:
    """Sorted array of the forms of a display name: itself, "First Last" of "Last, First", first
    name, surname, "F Last", "F. Last", initials with and without periods. '' has none."""
    v = _clean(variant)
    before, after = _clean(F.regexp_extract(v, r"^([^,]*),(.*)$", 1)), _clean(F.regexp_extract(v, r"^([^,]*),(.*)$", 2))
    turned = F.when((before != "") & (after != ""), F.concat(after, F.lit(" "), before))
    words = F.filter(F.split(F.coalesce(turned, F.replace(v, F.lit(","), F.lit(" "))), " +"), lambda x: x != "")
    given, surname, several = F.get(words, 0), F.try_element_at(words, F.lit(-1)), F.size(words) > 1
    initials = F.transform(words, _first)
    more = F.when(several, F.array(F.concat_ws(" ", given, surname), F.concat_ws(" ", _first(given), surname), F.concat(_first(given), F.lit(". "), surname), F.array_join(initials, ""), F.concat(F.array_join(initials, "."), F.lit(".")))).otherwise(F.array().cast("array<string>"))
    some = F.concat(F.array(v, turned, given, surname), more)
    return F.when((v != "") & (F.size(words) > 0), F.array_sort(F.array_distinct(F.array_compact(some)))).otherwise(F.array().cast("array<string>"))


def login_forms(address: Column) -> Column:
    """Sorted array of the login forms of an address: its local part and, if that has two parts
    or more, their usual combinations."""
    local = F.get(F.split(address, "@"), 0)
    parts = F.filter(F.split(local, "[._-]+"), lambda x: x != "")
    a, b = F.get(parts, 0), F.try_element_at(parts, F.lit(-1))
    more = F.when(F.size(parts) >= 2, F.array(F.concat_ws(".", a, b), F.concat_ws("_", a, b), F.concat(a, b), F.concat(_first(a), b), F.concat(b, _first(a)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(local), more)))


def entry_forms(roster: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(address, variant, kind): every name and login form of every roster entry that is long enough."""
    names = roster.select("address", F.explode(F.flatten(F.transform("display_name_variants", name_forms))).alias("variant"), F.lit("name").alias("kind"))
    logins = roster.select("address", F.explode(F.concat("exchange_logins", login_forms(F.col("address")))).alias("variant"), F.lit("login").alias("kind"))
    return names.unionByName(logins).filter(F.length("variant") >= min_length).distinct()


def variant_owners(forms: DataFrame) -> DataFrame:
    """(variant, owners, n): the addresses that own a form, in any case."""
    return forms.groupBy(F.lower("variant").alias("variant")).agg(F.array_sort(F.collect_set("address")).alias("owners")).withColumn("n", F.size("owners"))


def related_addresses(roster: DataFrame, address: str) -> DataFrame:
    """(address) of the entry and of every entry that shares a display name with it, in any
    case; one step, not transitive."""
    names = roster.select("address", F.explode("display_name_variants").alias("name")).select("address", F.lower(_clean(F.col("name"))).alias("name")).filter("name <> ''")
    mine = names.filter(F.col("address") == address).select("name").distinct()
    own = roster.sparkSession.createDataFrame([(address,)], "address string")
    return names.join(mine, "name", "left_semi").select("address").unionByName(own).distinct()


def alias_set(roster: DataFrame, address: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """(variant, kind, is_label) of a person: all forms of their addresses, the addresses
    themselves, and whether no other entry owns the form. An unknown address has only itself."""
    forms = entry_forms(roster, min_length)
    mine = related_addresses(roster, address)
    own = forms.join(mine, "address", "left_semi").select("variant", "kind")
    foreign = forms.join(mine, "address", "left_anti").select(F.lower("variant").alias("lv")).distinct()
    every = own.unionByName(mine.select(F.col("address").alias("variant"), F.lit("address").alias("kind"))).groupBy("variant").agg(F.min("kind").alias("kind"))
    marked = every.withColumn("lv", F.lower("variant")).join(foreign.withColumn("shared", F.lit(True)), "lv", "left")
    return marked.select("variant", "kind", F.col("shared").isNull().alias("is_label"))


def build_pattern(variants: list[str]) -> str | None:
    """One pattern for all variants: any case, the longest first, not inside a longer word;
    None without variants. The list is one person's, a few dozen forms."""
    ordered = sorted({v for v in variants if v}, key=lambda v: (-len(v), v))
    if not ordered:
        return None
    return r"(?iuU)(?<!\w)(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\\1", v) for v in ordered) + r")(?!\w)"
