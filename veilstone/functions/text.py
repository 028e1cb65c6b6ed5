"""Column builders for text: cleaning, tokens, spans and windows.

Everything here is a Spark SQL expression, so it stays inside whole-stage code generation.
Patterns carry (?U) or (?iuU) where words and white space are meant in the Unicode sense.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def collapse(text: Column) -> Column:
    """White space runs as one blank, trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def near_dup_key(text: Column, prefix: int = 300) -> Column:
    """SHA-1 of the first `prefix` characters of the collapsed text."""
    return F.sha1(F.substring(collapse(text), 1, prefix))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, figures and underscores; null gives the empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def token_line(text: Column) -> Column:
    """The tokens between single blanks, with a blank at both ends: phrases are substrings of it."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the tokens of phrase stand next to each other in the text."""
    return F.contains(token_line(text), token_line(F.lit(phrase)))


def strip_tags(text: Column) -> Column:
    """Mark-up replaced by blanks where there is any, white space collapsed."""
    return collapse(F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(text))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def find_verbatim(text: Column, value: Column) -> Column:
    """The first occurrence of value in any case, as the text spells it; null if absent or blank."""
    at = F.instr(F.lower(text), F.lower(value))
    return F.when((at > 0) & (F.length(value) > 0), F.substring(text, at, F.length(value)))


def split_halves(text: Column, least: int = 200) -> Column:
    """struct(a, b): the text cut behind the first sentence end at or after its middle, or in
    the middle if fewer than `least` characters would remain; both trimmed."""
    middle = F.floor(F.length(text) / 2).cast("int")
    found = F.call_function("locate", F.lit(". "), text, middle + 1)
    cut = F.when((found > 0) & (F.length(text) - found - 1 >= least), found + 1).otherwise(middle)
    return F.struct(F.trim(F.substring(text, F.lit(1), cut)).alias("a"), F.trim(F.substring(text, cut + 1, F.length(text))).alias("b"))


def last_index(text: Column, needle: str) -> Column:
    """0-based place of the last occurrence of needle, -1 if there is none."""
    back = F.instr(F.reverse(text), needle[::-1])
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(text) - back - len(needle) + 1)


def clean_body(text: Column, limit: int, markers: tuple[str, ...]) -> Column:
    """The collapsed text, cut to `limit` characters: at the last quotation marker that starts
    behind a third of the limit, else at the last blank, with " ..." behind it."""
    flat = collapse(text)
    head = F.substring(flat, 1, limit)
    marker = F.greatest(*(last_index(head, m) for m in markers)) if len(markers) > 1 else last_index(head, markers[0])
    blank = last_index(head, " ")
    short = (
        F.when(marker > limit // 3, F.trim(F.substring(head, F.lit(1), marker)))
        .when(blank > 0, F.concat(F.substring(head, F.lit(1), blank), F.lit(" ...")))
        .otherwise(F.concat(head, F.lit(" ...")))
    )
    return F.when(F.length(flat) <= limit, flat).otherwise(short)


def split_list(text: Column) -> Column:
    """The trimmed, non-empty parts between commas; null gives the empty list."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<i, start, stop, hit>> of all matches, offsets from 0. The pieces between
    matches and the matches themselves give the offsets, as no engine returns them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?") else pattern[: pattern.index(")") + 1] + f"({pattern[pattern.index(')') + 1:]})"), 1)
    start = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,start:int,stop:int,hit:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["h"])).alias("at"),
            F.array_append(a["out"], F.struct((F.size(a["out"]) + 1).alias("i"), (a["at"] + F.length(x["g"])).alias("start"), (a["at"] + F.length(x["g"]) + F.length(x["h"])).alias("stop"), x["h"].alias("hit"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(hits) > 0, start).otherwise(F.array().cast("array<struct<i:int,start:int,stop:int,hit:string>>"))


def masked_id(value: Column, namespace: str) -> Column:
    """An opaque document id: m- and twelve hex digits of the SHA-1 of namespace:value."""
    return F.concat(F.lit("m-"), F.substring(F.sha1(F.concat(F.lit(namespace + ":"), value.cast("string"))), 1, 12))


def is_opaque_id(value: Column) -> Column:
    return value.rlike("^m-[0-9a-f]{12}$")


def url_path(value: Column) -> Column:
    """Percent-encoding of everything but unreserved characters, the slash included."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_terms_present(value: str) -> bool:
    """Whether a phrase has any token at all."""
    return any(c.isalnum() or c == "_" for c in value)
