"""Finding documents that name a person outright, in text or in identity fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.personal import scan
from ..functions.text import find_verbatim, has_phrase, query_terms_present

#: Words in a field's name that mark it as naming people (fixed values).
IDENTITY_HINT = (
    r"(?:^|[._-])(?:user|username|userid|actor|principal|subject|author|owner|assignee|reporter|custodian|employee|account|email|mail|from|to|cc|sender|recipient|caller|agent|operator|created_by|updated_by|reviewer|party|parties|name)(?:$|[._-])"
)
EVALUATION = "doc_id string, index string, is_identifiable boolean, confidence_score double, identifying_snippets array<string>, identifying_fields array<struct<field:string,value:string,matched:string,type:string>>, reasoning string, text string, timestamp timestamp"


def _holds(value: str):
    """Literal containment in any case: * and ? in a value are characters like others, as the
    verdict on a field is literal too; a search engine would take them as wildcards."""
    return lambda x: F.contains(F.lower(x), F.lit(value.lower()))


def normalize_identifiers(**groups: list[str]) -> list[tuple[str, str]]:
    """(type, value) pairs of option groups: trimmed, blanks dropped, ids named employee_id."""
    return [("employee_id" if kind == "id" else kind, v.strip()) for kind, values in groups.items() for v in values or [] if v and v.strip()]


def naming_fields(schema: T.StructType, text_field: str) -> list[tuple[str, str, bool]]:
    """(field, type, searchable) of the string fields whose name holds an identity hint as a
    part delimited by dots, dashes or underscores, by name. The searched field is left out;
    metadata {"searchable": false} marks a field that cannot be searched."""
    hint = re.compile(IDENTITY_HINT, re.I)
    out = []

    def walk(struct: T.StructType, prefix: str) -> None:
        for f in struct.fields:
            name = prefix + f.name
            kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(kind, T.StructType):
                walk(kind, name + ".")
            elif isinstance(kind, T.StringType) and name != text_field and hint.search(name):
                out.append((name, "array" if isinstance(f.dataType, T.ArrayType) else "string", f.metadata.get("searchable", True)))

    walk(schema, "")
    return sorted(out)


def identity_fields(schema: T.StructType, text_field: str) -> list[str]:
    return [f for f, _, searchable in naming_fields(schema, text_field) if searchable]


def values_of(schema: T.StructType, field: str) -> Column:
    """A field as an array of strings: a scalar becomes a list of one, null the empty list."""
    dtype: T.DataType = schema
    for part in field.split("."):
        dtype = dtype[part].dataType
    empty = F.array().cast("array<string>")
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.filter(F.col(field), lambda x: x.isNotNull()), empty)
    return F.when(F.col(field).isNotNull(), F.array(F.col(field))).otherwise(empty)


def field_matches(schema: T.StructType, identifiers: list[tuple[str, str]], fields: list[str]) -> Column:
    """array<struct<field, value, matched, type>>: for each field and identifier the first
    value that contains the identifier in any case, and how it is spelled there."""
    out = []
    for field in fields:
        for kind, value in identifiers:
            hit = F.get(F.filter(values_of(schema, field), _holds(value)), 0)
            out.append(F.struct(F.lit(field).alias("field"), hit.alias("value"), find_verbatim(hit, F.lit(value)).alias("matched"), F.lit(kind).alias("type")))
    if not out:
        return F.array().cast("array<struct<field:string,value:string,matched:string,type:string>>")
    return F.filter(F.array(*out), lambda x: x["value"].isNotNull())


def matches(df: DataFrame, identifiers: list[tuple[str, str]], text: str, fields: list[str]) -> Column:
    """The direct query: an identifier's tokens stand in the text as a phrase, or a field holds
    it, whole or as a part in any case. All clauses are one predicate of the scan."""
    clauses = [has_phrase(F.col(text), v) for _, v in identifiers if query_terms_present(v)]
    clauses += [F.exists(values_of(df.schema, f), _holds(v)) for f in fields for _, v in identifiers]
    if not clauses:
        return F.lit(False)
    out = clauses[0]
    for c in clauses[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def discover_direct(df: DataFrame, identifiers: list[tuple[str, str]], key: str = "_id", text: str = "message", index: str = "", stamp: str | None = None,
                    fields: list[str] | None = None, pii_scan: bool = True, size: int | None = None) -> DataFrame:
    """Evaluations (EVALUATION) of every matching document.

    Flagged at 1.0 if an identifier stands in the text verbatim, a field holds one, or the scan
    finds any identifier-shaped value in the text of a matching document. Only the first
    spelling of an identifier becomes a snippet. Without identifiers the result is empty.
    Nothing is cut off unless `size` is given (then by key).
    """
    fields = identity_fields(df.schema, text) if fields is None else fields
    rows = df.filter(matches(df, identifiers, text, fields))
    if size is not None:
        rows = rows.orderBy(key).limit(size)
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    own = F.filter(F.array(*(find_verbatim(t, F.lit(v)) for _, v in identifiers)), lambda x: x.isNotNull()) if identifiers else none
    kinds = F.filter(F.array(*(F.when(find_verbatim(t, F.lit(v)).isNotNull(), F.lit(k)) for k, v in identifiers)), lambda x: x.isNotNull()) if identifiers else none
    found = scan(t) if pii_scan else F.array().cast("array<struct<kind:string,value:string>>")
    rows = rows.select(
        F.col(key).cast("string").alias("doc_id"), t.alias("text"), (F.col(stamp) if stamp else F.lit(None)).cast("timestamp").alias("timestamp"),
        own.alias("own"), kinds.alias("kinds"), found.alias("found"), field_matches(df.schema, identifiers, fields).alias("hits"),
    )
    flagged = (F.size("own") > 0) | (F.size("found") > 0) | (F.size("hits") > 0)
    types = F.array_sort(F.array_distinct(F.concat("kinds", F.transform("found", lambda x: x["kind"]), F.transform("hits", lambda x: x["type"]))))
    places = F.array_compact(F.array(F.when((F.size("own") > 0) | (F.size("found") > 0), F.lit("text")), F.when(F.size("hits") > 0, F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["field"]))), ", "))))
    return rows.select(
        "doc_id", F.lit(index).alias("index"), flagged.alias("is_identifiable"), flagged.cast("double").alias("confidence_score"),
        F.array_distinct(F.concat("own", F.transform("found", lambda x: x["value"]))).alias("identifying_snippets"), F.col("hits").alias("identifying_fields"),
        F.when(flagged, F.concat(F.lit("Identifiers found ("), F.array_join(types, ", "), F.lit(") in "), F.array_join(places, " and "))).otherwise("No identifier stands in the document").alias("reasoning"),
        "text", "timestamp",
    )
