"""Queries of judgment, plans, redaction, masking and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import actions, alias, audit, judge, masking
from ..operators.dedupe import one_per_key
from ..sources.tables import table
from .registry import Registry

R = Registry()
#: The parameters of the test evaluations: documents are judged by arithmetic on their id.
VARIANTS = ["Quenby Dravane", "Dravane", "Yusuf", "the controller"]
LABELS = ["Quenby Dravane", "Dravane"]
_CONF = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST((doc_id * 37) % 100 AS DOUBLE) / 100 END"
_EV = f"""ev AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'documents' AS index, doc_id % 3 <> 0 AS is_identifiable, {_CONF} AS confidence_score,
 list_filter([substring(text, 1, 12), substring(text, 40, 8), 'Zz absent'], lambda x: x IS NOT NULL AND x <> '') AS snippets, text FROM documents)"""


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    confidence = F.when(F.col("doc_id") % 11 != 0, ((F.col("doc_id") * 37) % 100).cast("double") / 100)
    snippets = F.array(F.substring("text", 1, 12), F.substring("text", 40, 8), F.lit("Zz absent"), F.lit(""), F.lit(None).cast("string"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("documents").alias("index"), (F.col("doc_id") % 3 != 0).alias("is_identifiable"), confidence.alias("confidence_score"), snippets.alias("identifying_snippets"), "text")


def _register_filter(mode: str) -> None:
    @R.add(f"WITH {_EV} SELECT doc_id, coalesce(confidence_score, 0e0) AS confidence_score, array_to_string(snippets, '|') AS snippets FROM ev WHERE is_identifiable AND coalesce(confidence_score, 0) >= {judge.threshold_for(mode)}", name=f"filter_flagged_{mode}")
    def query(spark, d):
        kept = judge.filter_flagged(evaluations(spark, d), mode)
        return kept.select("doc_id", "confidence_score", F.array_join("identifying_snippets", "|").alias("snippets"))


for _mode in judge.MODES:
    _register_filter(_mode)


@R.add(f"WITH {_EV} SELECT doc_id FROM ev WHERE is_identifiable AND coalesce(confidence_score, 0) >= 0.75")
def flagged_at(spark, d):
    return judge.flagged_at(evaluations(spark, d), 0.75)


@R.add(f"WITH {_EV} SELECT doc_id FROM ev WHERE substring(sha1('derive/v1:' || doc_id), 40, 1) NOT IN ('0','2','4','6','8','a','c','e')")
def without_derive_half(spark, d):
    from ..operators.metrics import in_derive_half

    ev = evaluations(spark, d)
    return judge.without(ev, ev.filter(in_derive_half(F.col("doc_id")))).select("doc_id")


@R.add(f"WITH {_EV} SELECT e.doc_id, d.created_at AS timestamp FROM ev e JOIN documents d ON CAST(d.doc_id AS VARCHAR) = e.doc_id WHERE is_identifiable AND coalesce(confidence_score, 0) >= 0.6")
def enrich_evaluations(spark, d):
    cands = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("documents").alias("index"), "text", F.col("created_at").alias("timestamp"))
    return judge.filter_flagged(evaluations(spark, d).drop("text"), "high_recall", cands).select("doc_id", "timestamp")


@R.add("SELECT doc_id, index, pattern FROM (SELECT DISTINCT CAST(log_id AS VARCHAR) AS doc_id, _index AS index, CASE WHEN _index GLOB 'hold-*' THEN 'hold-*' WHEN _index GLOB '*application*' THEN '*application*' END AS pattern FROM logs) WHERE pattern IS NOT NULL")
def legal_hold_violations(spark, d):
    logs = table(spark, d, "logs", "log_id", "_index").distinct().select(F.col("log_id").cast("string").alias("doc_id"), F.col("_index").alias("index"))
    return actions.hold_violations(logs, ["hold-*", "*application*"])


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return judge.filter_flagged(evaluations(spark, d), "balanced")


@R.add(f"WITH {_EV} SELECT doc_id, index, 'redact' AS operation, array_to_string(snippets, '|') AS snippets FROM ev WHERE is_identifiable AND coalesce(confidence_score, 0) >= 0.75")
def action_plan(spark, d):
    return actions.action_plan(flagged(spark, d), "redact_in_place").select("doc_id", "index", "operation", F.array_join("snippets", "|").alias("snippets"))


_RED = "CASE WHEN is_identifiable AND coalesce(confidence_score, 0) >= 0.75 THEN list_reduce([text] || snippets, lambda t, s: replace(t, s, '[GDPR_REDACTED]')) ELSE text END"


def as_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("message"))


@R.add(f"WITH {_EV} SELECT doc_id AS _id, {_RED} AS message FROM ev")
def redact_text(spark, d):
    plan = actions.action_plan(flagged(spark, d), "redact_in_place")
    return actions.apply_redaction(as_docs(spark, d), plan)


@R.add("SELECT DISTINCT mail_id, array_to_string(list_transform(mail_to, lambda x: CASE WHEN contains(lower(x), 'dravane') OR contains(lower(x), 'yusuf') THEN '[GDPR_REDACTED]' ELSE x END), '|') AS mail_to FROM mail WHERE mail_to IS NOT NULL")
def redact_fields(spark, d):
    m = table(spark, d, "mail", "mail_id", "mail_to").distinct().filter("mail_to is not null")
    return m.select("mail_id", F.array_join(actions.redact_values(F.col("mail_to"), F.array(F.lit("Dravane"), F.lit("yusuf"))), "|").alias("mail_to"))


@R.add(f"WITH {_EV} SELECT doc_id AS _id FROM ev WHERE NOT (is_identifiable AND coalesce(confidence_score, 0) >= 0.75)")
def hard_delete(spark, d):
    return actions.hard_delete(as_docs(spark, d), actions.action_plan(flagged(spark, d), "hard_delete")).select("_id")


@R.add(f"WITH {_EV}, r AS (SELECT doc_id, snippets, coalesce({_RED}, '') AS m FROM ev WHERE is_identifiable AND coalesce(confidence_score, 0) >= 0.75) SELECT doc_id, 'redact' AS operation, len(list_filter(snippets, lambda s: contains(m, s))) = 0 AS ok FROM r")
def read_back(spark, d):
    plan = actions.action_plan(flagged(spark, d), "redact_in_place")
    return actions.read_back(actions.apply_redaction(as_docs(spark, d), plan), plan).select("doc_id", "operation", "ok")


_KEPT = "is_identifiable AND coalesce(confidence_score, 0) >= 0.75"
_URL = "$SEARCH_URL/documents/_doc/"


@R.add(f"""WITH {_EV}, k AS (SELECT doc_id FROM ev WHERE {_KEPT}) SELECT '' AS doc_id, '' AS index, -2 AS part, '#!/bin/sh' AS line UNION ALL SELECT '', '', -1, 'set -eu' UNION ALL
SELECT doc_id, 'documents', CAST(p.part AS INTEGER), replace(p.line, '%', doc_id) FROM k, (VALUES (0, '# delete documents %'), (1, 'curl -sS --fail -X DELETE "{_URL}%?refresh=true"'), (2, '# read back delete documents %'), (3, '! curl -sS --fail -o /dev/null "{_URL}%"')) p(part, line)""")
def remediation_script(spark, d):
    return actions.remediation_script(actions.action_plan(flagged(spark, d), "hard_delete"))


@R.add(f"""WITH {_EV}, k AS (SELECT doc_id FROM ev WHERE {_KEPT}), i AS (SELECT list(doc_id ORDER BY doc_id) AS ids FROM (SELECT doc_id FROM k ORDER BY doc_id LIMIT 10))
SELECT 'POST' AS method, '/<index>/_delete_by_query' AS path, '{{"query":{{"ids":{{"values":["' || array_to_string(ids, '","') || '"]}}}}}}' AS body, (SELECT count(*) FROM k) AS documents FROM i WHERE ids IS NOT NULL""")
def request_preview(spark, d):
    return actions.request_preview(actions.action_plan(flagged(spark, d), "hard_delete"))


# -- two searches and two indexes

_EV2 = "ev2 AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'documents' ELSE 'archive' END AS index, 1.0e0 AS confidence_score, list_filter([substring(text, 20, 9)], lambda x: x IS NOT NULL AND x <> '') AS snippets FROM documents WHERE doc_id % 4 < 2)"
_BOTH = f"""WITH {_EV}, {_EV2}, b AS (SELECT index, doc_id, max(confidence_score) AS confidence_score, list_sort(list_distinct(flatten(list(snippets)))) AS snippets FROM (
SELECT index, doc_id, coalesce(confidence_score, 0e0) AS confidence_score, snippets FROM ev WHERE {_KEPT} UNION ALL SELECT index, doc_id, confidence_score, snippets FROM ev2) GROUP BY 1, 2)"""


def both_searches(spark: SparkSession, d: str) -> DataFrame:
    """Indirect evaluations and those of a direct search that finds other snippets, half of them in another index."""
    docs = table(spark, d, "documents", "doc_id", "text").filter("doc_id % 4 < 2")
    direct = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, "documents").otherwise("archive").alias("index"), F.lit(True).alias("is_identifiable"),
                         F.lit(1.0).alias("confidence_score"), F.filter(F.array(F.substring("text", 20, 9)), lambda x: x.isNotNull() & (x != "")).alias("identifying_snippets"))
    return actions.union_flagged(flagged(spark, d), direct)


@R.add(f"{_BOTH} SELECT index, doc_id, confidence_score, array_to_string(snippets, '|') AS snippets FROM b")
def union_flagged(spark, d):
    return both_searches(spark, d).select("index", "doc_id", "confidence_score", F.array_join(F.array_sort("identifying_snippets"), "|").alias("snippets"))


def two_indexes(spark: SparkSession, d: str) -> DataFrame:
    """The documents in two indexes that share their ids."""
    return as_docs(spark, d).withColumn("_index", F.explode(F.array(F.lit("documents"), F.lit("archive"))))


@R.add(f"{_BOTH}, i AS (SELECT * FROM (VALUES ('documents'), ('archive')) v(_index)) SELECT i._index, CAST(d.doc_id AS VARCHAR) AS _id, CASE WHEN len(b.snippets) > 0 THEN list_reduce([text] || b.snippets, lambda t, s: replace(t, s, '[GDPR_REDACTED]')) ELSE text END AS message FROM documents d, i LEFT JOIN b ON b.index = i._index AND b.doc_id = CAST(d.doc_id AS VARCHAR)".replace("FROM documents d, i LEFT", "FROM documents d CROSS JOIN i LEFT"))
def redact_two_indexes(spark, d):
    plan = actions.action_plan(both_searches(spark, d), "redact_in_place")
    return actions.apply_redaction(two_indexes(spark, d), plan.withColumn("snippets", F.array_sort("snippets"))).select("_index", "_id", "message")


@R.add(f"{_BOTH} SELECT i._index, CAST(d.doc_id AS VARCHAR) AS _id FROM documents d CROSS JOIN (VALUES ('documents'), ('archive')) i(_index) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.index = i._index AND b.doc_id = CAST(d.doc_id AS VARCHAR))")
def delete_two_indexes(spark, d):
    return actions.hard_delete(two_indexes(spark, d), actions.action_plan(both_searches(spark, d), "hard_delete")).select("_index", "_id")


@R.add("SELECT DISTINCT folder, replace(replace(url_encode(folder), '+', '%20'), '%7E', '~') AS path FROM mail WHERE folder IS NOT NULL")
def url_paths(spark, d):
    return table(spark, d, "mail", "folder").distinct().filter("folder is not null").select("folder", tx.url_path(F.col("folder")).alias("path"))


# -- masking: the comparing engine has no look-around, so boundaries become marks on either side of every non-word character

_ENC = r"regexp_replace({}, '([^\p{{L}}\p{{N}}_])', E'\x01' || '\1' || E'\x02', 'g')"


def _alternatives(variants: list[str]) -> str:
    import re

    ordered = sorted(set(variants), key=lambda v: (-len(v), v))
    return "|".join(re.sub(r"([^\w])", lambda m: "\x01" + m.group(1) + "\x02", v) for v in ordered)


def _mask_sql(variants: list[str]) -> str:
    pattern = f"'(?i)(^|\x02)(?:{_alternatives(variants)})(\x01|$)'"
    return f"""e AS (SELECT doc_id, text, {_ENC.format("coalesce(text, '')")} AS x FROM documents), h AS (SELECT doc_id, text, len(regexp_extract_all(x, {pattern})) AS hits, replace(replace(regexp_replace(x, {pattern}, '\\1\\2', 'g'), '\x01', ''), '\x02', '') AS y FROM e)"""


PATTERN, LABEL_PATTERN = alias.build_pattern(VARIANTS), alias.build_pattern(LABELS)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return masking.masked_corpus(table(spark, d, "documents", "doc_id", "text", "created_at"), PATTERN, LABEL_PATTERN, "doc_id", "text", "created_at")


@R.add(rf"WITH {_mask_sql(VARIANTS)} SELECT doc_id AS original_id, 'm-' || substring(sha1('veilstone/masked/v1:' || doc_id), 1, 12) AS _id, CAST(hits AS INTEGER) AS hits, CASE WHEN hits > 0 THEN trim(regexp_replace(y, '[\s\x0B\x85\p{{Z}}]{{2,}}', ' ', 'g')) ELSE y END AS message FROM h")
def mask_corpus(spark, d):
    return corpus(spark, d).select("original_id", "_id", "hits", "message")


@R.add(f"WITH {_mask_sql(VARIANTS)} SELECT count(*) AS scanned, count(*) FILTER (hits > 0) AS masked, CAST(sum(hits) AS BIGINT) AS total_hits FROM h")
def masking_stats(spark, d):
    return masking.masking_stats(corpus(spark, d)).drop("positives")


def _found_sql(variants: list[str], source: str, key: str) -> str:
    """SQL of (key, i, form): every occurrence of a variant in the texts of source (key, t), in order."""
    pattern = f"'(?i)(^|\x02)({_alternatives(variants)})(\x01|$)'"
    return f"SELECT {key}, unnest(range(1, len(h) + 1)) AS i, replace(replace(unnest(h), '\x01', ''), '\x02', '') AS form FROM (SELECT {key}, regexp_extract_all({_ENC.format('t')}, {pattern}, 2) AS h FROM {source} WHERE t IS NOT NULL)"


@R.add(f"SELECT doc_id, string_agg(form, '|' ORDER BY i) AS found FROM (SELECT doc_id, i, form, row_number() OVER (PARTITION BY doc_id, lower(form) ORDER BY i) AS n FROM ({_found_sql(VARIANTS, '(SELECT doc_id, text AS t FROM documents)', 'doc_id')})) WHERE n = 1 GROUP BY doc_id")
def find_variants(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.array_join(masking.find_variants(F.col("text"), PATTERN), "|").alias("found")).filter("found <> ''")


# positives and the gate are looked at on mails, whose texts hold the name

_MAILS = "(SELECT mail_id, any_value(message) AS t FROM mail GROUP BY mail_id)"
_HELD = f"p AS (SELECT mail_id, count(DISTINCT lower(form)) AS label_hits FROM ({_found_sql(LABELS, _MAILS, 'mail_id')}) GROUP BY mail_id)"


def masked_mail(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "mail", "mail_id", "message", "ts"), "mail_id", ["message", "ts"])
    return masking.masked_corpus(rows, PATTERN, LABEL_PATTERN, "mail_id", "message", "ts")


@R.add(f"WITH {_HELD} SELECT 'm-' || substring(sha1('veilstone/masked/v1:' || mail_id), 1, 12) AS doc_id, mail_id AS original_id, label_hits FROM p")
def masked_positives(spark, d):
    return masking.positives(masked_mail(spark, d))


_MASKED_MAIL = _mask_sql(VARIANTS).replace("SELECT doc_id, text, " + _ENC.format("coalesce(text, '')") + " AS x FROM documents", "SELECT mail_id AS doc_id, t AS text, " + _ENC.format("coalesce(t, '')") + f" AS x FROM {_MAILS}")
_MASKED_MAIL += r", m AS (SELECT CASE WHEN hits > 0 THEN trim(regexp_replace(y, '[\s\x0B\x85\p{Z}]{2,}', ' ', 'g')) ELSE y END AS m FROM h)"
_SIGNALS = r"len(list_filter(regexp_extract_all(m, '(\+?\d[\d\s().\-]{7,}\d)', 1), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 10)) + len(regexp_extract_all(m, '(?i)\b(?:x|ext\.?|extension)\s*\d{3,6}\b'))"


@R.add(f"""WITH {_MASKED_MAIL} SELECT survivors = 0 AS passed, CASE WHEN survivors > 0 THEN 'variants survive' ELSE '' END AS failures, documents, survivors, CAST(0 AS BIGINT) AS readable_ids, CAST(0 AS BIGINT) AS forbidden, phone_signals, CAST(0 AS BIGINT) AS marker_documents FROM (
SELECT count(*) AS documents, count(*) FILTER (regexp_matches({_ENC.format("m")}, '(?i)(^|\x02)(?:{_alternatives(VARIANTS)})(\x01|$)')) AS survivors, CAST(sum({_SIGNALS}) AS BIGINT) AS phone_signals FROM m)""")
def leakage_audit(spark, d):
    masked = masked_mail(spark, d).select("_id", "message", "ts")
    return masking.audit(masked, PATTERN).withColumn("failures", F.array_join("failures", "|"))


@R.add(f"WITH {_MASKED_MAIL} SELECT count(*) FILTER (n > 0) AS documents, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT len(regexp_extract_all(m, '(?i)Quenby|Dravane')) AS n FROM m)")
def loose_report(spark, d):
    return masking.loose_report(masked_mail(spark, d), ["Quenby", "Dravane", "QD"])


@R.add(f"WITH {_HELD} SELECT least(5, count(*)) AS checked, least(5, count(*)) AS confirmed FROM p")
def verify_positives(spark, d):
    mails = one_per_key(table(spark, d, "mail", "mail_id", "message"), "mail_id", ["message"])
    return masking.verify_positives(masking.positives(masked_mail(spark, d)), mails, LABEL_PATTERN, "mail_id", "message")


# -- the audit log

def chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain of certificates, one for each region and nation."""
    nation = table(spark, d, "nation").select(F.lpad("n_nationkey", 4, "0").alias("timestamp"), F.to_json(F.struct("n_name", "n_nationkey")).alias("record_json"))
    return audit.chained(nation)


_CHAIN = """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY lpad(CAST(n_nationkey AS VARCHAR), 4, '0')) - 1 AS seq, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS record_json FROM nation),
c(seq, record_json, prev_hash, entry_hash) AS (SELECT seq, record_json, 'GENESIS', sha256(record_json || 'GENESIS') FROM r WHERE seq = 0 UNION ALL SELECT r.seq, r.record_json, c.entry_hash, sha256(r.record_json || c.entry_hash) FROM c JOIN r ON r.seq = c.seq + 1),
t AS (SELECT seq, CASE WHEN seq = BROKEN THEN record_json || ' ' ELSE record_json END AS record_json, prev_hash, entry_hash FROM c),
k AS (SELECT seq, prev_hash = coalesce(lag(entry_hash) OVER (ORDER BY seq), 'GENESIS') AND entry_hash = sha256(record_json || prev_hash) AS ok FROM t)
"""
_VERIFIED = _CHAIN + "SELECT count(*) AS entries, coalesce(bool_and(ok), true) AS intact, min(seq) FILTER (NOT ok) AS broken_at FROM k"


@R.add(_VERIFIED.replace("BROKEN", "-1"))
def audit_chain(spark, d):
    return audit.verify_chain(chain(spark, d), "seq")


@R.add(_VERIFIED.replace("BROKEN", "7"))
def audit_chain_broken(spark, d):
    broken = chain(spark, d).withColumn("record_json", F.when(F.col("seq") == 7, F.concat("record_json", F.lit(" "))).otherwise(F.col("record_json")))
    return audit.verify_chain(broken, "seq")


@R.add(_CHAIN.replace("BROKEN", "-1") + "SELECT seq AS timestamp, entry_hash FROM c ORDER BY seq DESC LIMIT 20")
def audit_list(spark, d):
    return audit.list_entries(chain(spark, d).withColumnRenamed("seq", "timestamp"), 20).select("timestamp", "entry_hash")
