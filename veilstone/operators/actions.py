"""Plans, redaction, deletion, legal holds and the reviewable script.

Nothing here changes stored data: redaction and deletion return new DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_path
from .direct import values_of

#: What replaces redacted text (fixed value).
TOKEN = "[GDPR_REDACTED]"


class LegalHold(Exception):
    """A document to be changed lies in an index on hold."""


def glob_regex(pattern: str) -> str:
    """A shell pattern (*, ?, [...]) as a regular expression for a whole value."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def hold_violations(flagged: DataFrame, patterns: list[str], index: str = "index") -> DataFrame:
    """(doc_id, index, pattern): flagged documents whose index matches a hold pattern, with the
    first pattern that matches. Patterns are a short list, so they are one projection."""
    hits = [F.when(F.col(index).rlike(glob_regex(p)), F.lit(p)) for p in patterns]
    if not hits:
        return flagged.select("doc_id", index, F.lit(None).cast("string").alias("pattern")).filter("false")
    return flagged.select("doc_id", index, F.coalesce(*hits).alias("pattern")).filter("pattern is not null")


def assert_not_on_hold(flagged: DataFrame, patterns: list[str], index: str = "index") -> None:
    first = hold_violations(flagged, patterns, index).orderBy("doc_id").first()
    if first:
        raise LegalHold(f"{first['doc_id']} lies in {first[index]}, on hold by {first['pattern']}")


def field_values(hits: Column) -> Column:
    """map<field, array<string>>: what to redact in each field, the matched part or else the
    whole value, without repetition and in order."""
    names = F.array_distinct(F.transform(hits, lambda x: x["field"]))
    needles = F.transform(names, lambda n: F.array_distinct(F.transform(F.filter(hits, lambda x: x["field"] == n), lambda x: F.coalesce(F.when(x["matched"] != "", x["matched"]), x["value"]))))
    return F.map_from_arrays(names, needles)


def action_plan(flagged: DataFrame, action: str = "dry_run") -> DataFrame:
    """(doc_id, index, operation, snippets, fields): one operation per document, `redact`,
    `delete` or, for any other action, `preview_redact`."""
    operation = {"redact_in_place": "redact", "hard_delete": "delete"}.get(action, "preview_redact")
    fields = field_values(F.col("identifying_fields")) if "identifying_fields" in flagged.columns else F.create_map().cast("map<string,array<string>>")
    return flagged.select("doc_id", "index", F.lit(operation).alias("operation"), F.col("identifying_snippets").alias("snippets"), fields.alias("fields"))


def redact_text(text: Column, snippets: Column, token: str = TOKEN) -> Column:
    """The text with every snippet replaced, one after the other, literally and in this case."""
    kept = F.filter(F.coalesce(snippets, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    return F.aggregate(kept, text, lambda t, s: F.replace(t, s, F.lit(token)))


def _any_holds(values: Column, needles: Column) -> Column:
    """Whether any value contains any needle, in any case."""
    return F.exists(values, lambda v: F.exists(needles, lambda n: F.contains(F.lower(v), F.lower(n))))


def redact_values(values: Column, needles: Column, token: str = TOKEN) -> Column:
    """The list with every element that contains a needle in any case replaced as a whole."""
    return F.transform(values, lambda x: F.when(F.exists(needles, lambda n: F.contains(F.lower(x), F.lower(n))), F.lit(token)).otherwise(x))


def union_flagged(*evaluations: DataFrame) -> DataFrame:
    """(doc_id, index, is_identifiable, confidence_score, identifying_snippets, identifying_fields):
    one row per document of any of the given evaluations, of direct and indirect search say.
    Documents are told apart by index and id; the surer verdict stands, snippets and fields of
    all are kept, each once, in order. Columns an evaluation lacks count as empty."""
    empty = {"is_identifiable": F.lit(True), "confidence_score": F.lit(None).cast("double"), "identifying_snippets": F.array().cast("array<string>"),
             "identifying_fields": F.array().cast("array<struct<field:string,value:string,matched:string,type:string>>")}
    rows = [e.select("doc_id", "index", *((F.col(c) if c in e.columns else v).alias(c) for c, v in empty.items())) for e in evaluations]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    together = lambda c: F.array_distinct(F.flatten(F.array_sort(F.collect_set(c)))).alias(c)
    return every.groupBy("index", "doc_id").agg(F.max("is_identifiable").alias("is_identifiable"), F.max("confidence_score").alias("confidence_score"), together("identifying_snippets"), together("identifying_fields"))


def _todo(plan: DataFrame, operation: str) -> DataFrame:
    """(__k, __i, __s, __f): one row per document of a plan, with the snippets and the fields of all its rows."""
    mine = plan.filter(F.col("operation") == operation).select("doc_id", "index", F.coalesce("snippets", F.array().cast("array<string>")).alias("s"), F.coalesce("fields", F.create_map().cast("map<string,array<string>>")).alias("f"))
    one = mine.groupBy("doc_id", "index").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_set("s")))).alias("__s"), F.collect_list("f").alias("maps"))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("maps", F.map_keys))))
    needles = F.transform(names, lambda n: F.array_sort(F.array_distinct(F.flatten(F.transform("maps", lambda m: F.coalesce(m[n], F.array().cast("array<string>")))))))
    return one.select(F.col("doc_id").alias("__k"), F.col("index").alias("__i"), "__s", F.map_from_arrays(names, needles).alias("__f"))


def _same(docs: DataFrame, key: str, index: str) -> Column:
    """The condition that joins docs with a plan: the id and, if docs carry their index, the index.
    Docs without such a column all belong to one index, whose plan they are to be given."""
    same = docs[key].cast("string") == F.col("__k")
    return same & (docs[index] == F.col("__i")) if index in docs.columns else same


def _one_index(todo: DataFrame, docs: DataFrame, index: str) -> DataFrame:
    """Without an index column in docs, what is planned for one id is planned for one document."""
    if index in docs.columns:
        return todo
    return _todo(todo.select(F.lit("redact").alias("operation"), F.col("__k").alias("doc_id"), F.lit("").alias("index"), F.col("__s").alias("snippets"), F.col("__f").alias("fields")), "redact")


def apply_redaction(docs: DataFrame, plan: DataFrame, key: str = "_id", text: str = "message", fields: list[str] | None = None, token: str = TOKEN, index: str = "_index") -> DataFrame:
    """docs with the text and fields of every planned document redacted; others are untouched.
    A document is named by its index and id, if docs have the column `index`, else by its id.
    All rows a plan holds for it count. Scalar fields stay scalar, lists keep their length."""
    todo = _one_index(_todo(plan, "redact"), docs, index)
    rows = docs.join(todo, _same(docs, key, index), "left")
    out = []
    for f in docs.schema.fields:
        c = docs[f.name]
        if f.name == text:
            c = F.when(F.col("__k").isNotNull(), redact_text(c, F.col("__s"), token)).otherwise(c)
        elif f.name in (fields or []):
            needles = F.coalesce(F.col("__f")[f.name], F.array().cast("array<string>"))
            changed = redact_values(values_of(docs.schema, f.name), needles, token)
            c = F.when(F.size(needles) > 0, changed if f.dataType.typeName() == "array" else F.get(changed, 0)).otherwise(c)
        out.append(c.alias(f.name))
    return rows.select(*out)


def hard_delete(docs: DataFrame, plan: DataFrame, key: str = "_id", index: str = "_index") -> DataFrame:
    """docs without the documents planned for deletion, named as apply_redaction names them."""
    gone = plan.filter("operation = 'delete'").select(F.col("doc_id").alias("__k"), F.col("index").alias("__i")).distinct()
    return docs.join(gone, _same(docs, key, index), "left_anti")


def read_back(docs: DataFrame, plan: DataFrame, key: str = "_id", text: str = "message", fields: list[str] | None = None, index: str = "_index") -> DataFrame:
    """(doc_id, index, operation, ok): whether a deleted document is absent, and a redacted one
    present without any of its snippets and, in the given fields, without their planned values."""
    at = docs[index] if index in docs.columns else F.lit(None).cast("string")
    now = docs.select(F.col(key).cast("string").alias("__k"), at.alias("__at"), F.coalesce(F.col(text), F.lit("")).alias("__t"), F.lit(True).alias("__there"), *(values_of(docs.schema, f).alias(f"__v{i}") for i, f in enumerate(fields or [])))
    there = F.coalesce(F.col("__there"), F.lit(False))
    none = F.array().cast("array<string>")
    clean = ~F.exists(F.coalesce(F.col("snippets"), none), lambda s: F.contains(F.col("__t"), s) & (s != ""))
    for i, f in enumerate(fields or []):
        clean = clean & ~_any_holds(F.coalesce(F.col(f"__v{i}"), none), F.coalesce(F.col("fields")[f], none))
    ok = F.when(F.col("operation") == "delete", ~there).when(F.col("operation") == "redact", there & clean).otherwise(there)
    same = (plan["doc_id"] == now["__k"]) & ((plan["index"] == now["__at"]) if index in docs.columns else F.lit(True))
    return plan.join(now, same, "left").select(plan["doc_id"], plan["index"], plan["operation"], ok.alias("ok"))


#: What a search engine is asked to run on a document: replace every snippet in the text; replace every field value that holds a needle.
_TEXT_SCRIPT = "def t = ctx._source[params.field]; if (t instanceof String) { for (s in params.snippets) { t = t.replace(s, params.token); } ctx._source[params.field] = t; }"
_FIELD_SCRIPT = (
    "for (e in params.fields.entrySet()) { def v = ctx._source[e.getKey()]; if (v instanceof List) { for (int i = 0; i < v.size(); i++) { for (n in e.getValue()) {"
    " if (v[i] != null && v[i].toString().toLowerCase().contains(n.toLowerCase())) { v[i] = params.token; } } } }"
    " else if (v != null) { for (n in e.getValue()) { if (v.toString().toLowerCase().contains(n.toLowerCase())) { ctx._source[e.getKey()] = params.token; } } } }"
)


def _script_body(source: str, **params: Column) -> Column:
    """The JSON of a request that runs a script with parameters."""
    return F.to_json(F.struct(F.struct(F.lit("painless").alias("lang"), F.lit(source).alias("source"), F.struct(*(v.alias(k) for k, v in params.items())).alias("params")).alias("script")))


def remediation_script(plan: DataFrame, base: str = "$SEARCH_URL", text: str = "message", token: str = TOKEN) -> DataFrame:
    """(doc_id, index, part, line): a shell script for review that would carry out a plan, in the
    order of these columns. It is text only; building it executes nothing.

    Ids are percent-encoded in addresses; in comments their white space is one blank, so none
    leaves its line. Bodies stand in quoted here-documents of one line of JSON. curl fails on an
    error of the server (--fail), which ends the script. The last lines of a document read it back."""
    url = F.concat(F.lit(f"{base}/"), url_path(F.col("index")))
    one = F.concat(url, F.lit("/_doc/"), url_path(F.col("doc_id")))
    said = F.regexp_replace(F.concat(F.col("operation"), F.lit(" "), F.col("index"), F.lit(" "), F.col("doc_id")), r"\s+", " ")
    post = F.concat(F.lit('curl -sS --fail -X POST "'), url, F.lit("/_update/"), url_path(F.col("doc_id")), F.lit("?refresh=true\" -H 'Content-Type: application/json' --data-binary @- <<'JSON'\n"))
    body = _script_body(_TEXT_SCRIPT, field=F.lit(text), snippets=F.col("snippets"), token=F.lit(token))
    some = F.size(F.coalesce("snippets", F.array().cast("array<string>"))) > 0
    in_fields = _script_body(_FIELD_SCRIPT, fields=F.col("fields"), token=F.lit(token))
    redact = F.array_compact(F.array(
        F.when(some, F.concat(post, body, F.lit("\nJSON"))),
        F.when(F.size(F.coalesce("fields", F.create_map().cast("map<string,array<string>>"))) > 0, F.concat(post, in_fields, F.lit("\nJSON"))),
    ))
    remove = F.array(F.concat(F.lit('curl -sS --fail -X DELETE "'), one, F.lit('?refresh=true"')))
    change = F.when(F.col("operation") == "delete", remove).when(F.col("operation") == "redact", redact).otherwise(F.array(F.lit("# preview only")))
    check = F.when(F.col("operation") == "delete", F.concat(F.lit('! curl -sS --fail -o /dev/null "'), one, F.lit('"'))).otherwise(F.concat(F.lit('curl -sS --fail "'), one, F.lit('"')))
    parts = F.concat(F.array(F.concat(F.lit("# "), said)), change, F.array(F.concat(F.lit("# read back "), said), check))
    lines = plan.select("doc_id", "index", F.posexplode(parts).alias("part", "line"))
    head = plan.sparkSession.createDataFrame([("", "", -2, "#!/bin/sh"), ("", "", -1, "set -eu")], "doc_id string, index string, part int, line string")
    return head.unionByName(lines).orderBy("doc_id", "index", "part")


def request_preview(plan: DataFrame, text: str = "message", token: str = TOKEN, shown: int = 10) -> DataFrame:
    """One row (method, path, body, documents): how a request for the whole plan would look. It is
    an illustration: its body names the first `shown` ids and the snippets of the first document.
    An empty plan gives no row."""
    total = plan.count()
    first = plan.orderBy("doc_id", "index").select("doc_id", "operation", F.coalesce("snippets", F.array().cast("array<string>")).alias("snippets")).limit(shown)
    one = first.agg(F.array_sort(F.collect_list("doc_id")).alias("ids"), F.min_by("operation", "doc_id").alias("operation"), F.min_by("snippets", "doc_id").alias("snippets")).filter("operation is not null")
    query = F.struct(F.struct(F.col("ids").alias("values")).alias("ids")).alias("query")
    script = F.struct(F.lit("painless").alias("lang"), F.lit(_TEXT_SCRIPT).alias("source"), F.struct(F.lit(text).alias("field"), F.col("snippets"), F.lit(token).alias("token")).alias("params")).alias("script")
    deletes = F.col("operation") == "delete"
    return one.select(F.lit("POST").alias("method"), F.when(deletes, "/<index>/_delete_by_query").otherwise("/<index>/_update_by_query").alias("path"),
                      F.when(deletes, F.to_json(F.struct(query))).otherwise(F.to_json(F.struct(script, query))).alias("body"), F.lit(total).cast("bigint").alias("documents"))
