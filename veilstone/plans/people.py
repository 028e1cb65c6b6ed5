"""Queries about people: identifiers, rosters, aliases, captions, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import personal as pd_
from ..functions import text as tx
from ..operators import alias, captions, direct, roster, suitability
from ..operators.dedupe import one_per_key
from ..session import written
from ..sources.tables import has_field, table
from .registry import Registry
from .search import LINE

R = Registry()
#: A frequent correspondent of the test mail, the house's domain and mark; parameters of the queries only.
SUBJECT, DOMAIN, HOUSE = "quenby.dravane@halverton.example", "halverton.example", "HALVERTON"
IDENTIFIERS = [("name", "Dravane"), ("email", SUBJECT)]
FIELDS = ["mail_from", "mail_to"]


def mail(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return one_per_key(table(spark, d, "mail", "mail_id", *columns), "mail_id", list(columns))


_PHONES = r"list_filter(list_distinct(list_transform(regexp_extract_all(t, '(\+?\d[\d\s().\-]{7,}\d)', 1), lambda x: trim(x))), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 10)"
_EMAILS = r"list_distinct(list_transform(regexp_extract_all(t, '([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 1), lambda x: trim(x)))"
_IPV4 = r"list_distinct(list_transform(regexp_extract_all(t, '(\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b)', 1), lambda x: trim(x)))"


@R.add(f"WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'email' AS kind, unnest({_EMAILS}) AS value FROM d UNION ALL SELECT doc_id, 'ipv4', unnest({_IPV4}) FROM d UNION ALL SELECT doc_id, 'phone', unnest({_PHONES}) FROM d")
def pii_scan_long(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(pd_.scan(F.col("text"))).alias("p")).select("doc_id", "p.kind", "p.value")


@R.add()
def pii_scan_ipv6(spark, d):
    return table(spark, d, "logs", "log_id", "message").select("log_id", F.explode(pd_.scan(F.col("message"))).alias("p")).select("log_id", "p.kind", "p.value").distinct()


@R.add(r"SELECT DISTINCT mail_id, CAST(len(list_filter(regexp_extract_all(m, '(\+?\d[\d\s().\-]{7,}\d)', 1), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 10)) + len(regexp_extract_all(m, '(?i)\b(?:x|ext\.?|extension)\s*\d{3,6}\b')) AS INTEGER) AS signals FROM (SELECT mail_id, message AS m FROM mail WHERE message IS NOT NULL)")
def phone_signals(spark, d):
    return mail(spark, d, "message").filter("message is not null").select("mail_id", pd_.phone_signals(F.col("message")).alias("signals")).distinct()


@R.add("SELECT DISTINCT mail_id, substring(message, instr(lower(message), 'dravane'), 7) AS spelled FROM mail WHERE instr(lower(message), 'dravane') > 0")
def find_verbatim(spark, d):
    found = tx.find_verbatim(F.col("message"), F.lit("dravane"))
    return mail(spark, d, "message").select("mail_id", found.alias("spelled")).filter("spelled is not null")


@R.add("""SELECT DISTINCT mail_id, field, value, substring(value, instr(lower(value), lower(q)), length(q)) AS matched, type FROM (
SELECT mail_id, f.field, q.type, q.q, list_filter(CASE f.field WHEN 'mail_from' THEN [mail_from] ELSE coalesce(mail_to, []) END, lambda x: x IS NOT NULL AND contains(lower(x), lower(q.q)))[1] AS value
FROM mail, (VALUES ('mail_from'), ('mail_to')) f(field), (VALUES ('name', 'Dravane'), ('email', 'quenby.dravane@halverton.example')) q(type, q)) WHERE value IS NOT NULL""")
def field_matches(spark, d):
    m = mail(spark, d, *FIELDS)
    return m.select("mail_id", F.explode(direct.field_matches(m.schema, IDENTIFIERS, FIELDS)).alias("h")).select("mail_id", "h.field", "h.value", "h.matched", "h.type")


_DIRECT = f"""(contains({LINE.format('message')}, ' dravane ') OR contains({LINE.format('message')}, ' quenby dravane halverton example ') OR contains(lower(mail_from), 'dravane') OR len(list_filter(coalesce(mail_to, []), lambda x: contains(lower(x), 'dravane'))) > 0)"""


@R.add(f"SELECT DISTINCT mail_id FROM mail WHERE {_DIRECT}")
def direct_query(spark, d):
    m = mail(spark, d, "message", *FIELDS)
    return m.filter(direct.matches(m, IDENTIFIERS, "message", FIELDS)).select("mail_id")


def direct_evaluations(spark: SparkSession, d: str) -> DataFrame:
    m = mail(spark, d, "message", "ts", *FIELDS)
    return direct.discover_direct(m, IDENTIFIERS, "mail_id", "message", "mail", "ts", FIELDS)


@R.add(f"""SELECT CAST(mail_id AS VARCHAR) AS doc_id, s > 0 OR h > 0 AS is_identifiable, CASE WHEN s > 0 OR h > 0 THEN 1.0e0 ELSE 0e0 END AS confidence_score, CAST(h AS INTEGER) AS hits FROM (SELECT DISTINCT mail_id, len({_EMAILS}) + len({_IPV4}) + len({_PHONES}) + CASE WHEN instr(lower(t), 'dravane') > 0 THEN 1 ELSE 0 END AS s,
 CASE WHEN contains(lower(mail_from), 'dravane') THEN 1 ELSE 0 END + CASE WHEN contains(lower(mail_from), 'quenby.dravane@halverton.example') THEN 1 ELSE 0 END + CASE WHEN len(list_filter(coalesce(mail_to, []), lambda x: contains(lower(x), 'dravane'))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(coalesce(mail_to, []), lambda x: contains(lower(x), 'quenby.dravane@halverton.example'))) > 0 THEN 1 ELSE 0 END AS h
 FROM (SELECT *, coalesce(message, '') AS t FROM mail) WHERE {_DIRECT})""")
def direct_discover(spark, d):
    # the IPv6 shape needs look-around, which the comparing engine lacks; no mail holds one
    return direct_evaluations(spark, d).select("doc_id", "is_identifiable", "confidence_score", F.size("identifying_fields").alias("hits"))


@R.add("SELECT field, type, true AS searchable FROM (VALUES ('cc', 'array'), ('custodian', 'string'), ('mail_from', 'string'), ('mail_to', 'array'), ('subject', 'string'), ('x_cc', 'string'), ('x_from', 'string'), ('x_to', 'string')) v(field, type)")
def naming_channel(spark, d):
    rows = direct.naming_fields(table(spark, d, "mail").schema, "message")
    return spark.createDataFrame(rows, "field string, type string, searchable boolean")


# -- rosters

_PART = r"""p AS (SELECT mail_id, ts, custodian, 'from' AS role, unnest(regexp_extract_all(lower(mail_from), '([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})', 1)) AS address FROM m UNION ALL
SELECT mail_id, ts, custodian, 'to', unnest(regexp_extract_all(lower(array_to_string(mail_to, ', ')), '([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})', 1)) FROM m UNION ALL
SELECT mail_id, ts, custodian, 'cc', unnest(regexp_extract_all(lower(array_to_string(cc, ', ')), '([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})', 1)) FROM m)"""
_M = "m AS (SELECT DISTINCT mail_id, mail_from, mail_to, cc, x_from, x_to, x_cc, custodian, ts FROM mail)"
_WITH = f"WITH {_M}, {_PART}"
_PER = "q AS (SELECT mail_id, address, max(CASE WHEN role = 'from' THEN 1 ELSE 0 END) AS sent, any_value(ts) AS ts, any_value(custodian) AS custodian FROM p GROUP BY 1, 2)"
_COUNTS = f"{_WITH}, {_PER}, c AS (SELECT address, count(*) AS message_count FROM q GROUP BY 1)"


def people(spark: SparkSession, d: str) -> DataFrame:
    return roster.participants(mail(spark, d, *roster.HEADERS[1:]))


def entries(spark: SparkSession, d: str) -> DataFrame:
    # written once: the operators behind it read a roster several times
    return written(roster.entries(people(spark, d), DOMAIN), "roster")


@R.add(f"{_WITH} SELECT mail_id, role, address FROM p")
def participants(spark, d):
    return people(spark, d).select("mail_id", "role", "address")


# names of typed headers stand at the same place as the addresses, if there are equally many
_TIDY = r"trim(regexp_replace(trim({}), '^[\s,;''\"]+|[''\"\s]+$', '', 'g'))"
_FLAT, _ENTRY = r"trim(regexp_replace({}, '\s+', ' ', 'g'))", "'([^<>]*)<([^<>]*)>'"


def _side(role: str, addresses: str, typed: str) -> str:
    found = rf"coalesce(regexp_extract_all(lower({addresses}), '([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}})', 1), [])"
    x = _FLAT.format(typed)
    return f"SELECT mail_id, ts, custodian, '{role}' AS role, {found} AS a, coalesce(regexp_extract_all({x}, {_ENTRY}, 1), []) AS n, coalesce(regexp_extract_all({x}, {_ENTRY}, 2), []) AS l FROM m"


_NAMED = f"""WITH {_M}, sides AS ({" UNION ALL ".join((_side("from", "mail_from", "x_from"), _side("to", "array_to_string(mail_to, ', ')", "x_to"), _side("cc", "array_to_string(cc, ', ')", "x_cc")))}),
pn AS (SELECT mail_id, ts, custodian, role, a[i] AS address, CASE WHEN len(a) = len(n) THEN {_TIDY.format("n[i]")} ELSE '' END AS name, CASE WHEN len(a) = len(l) THEN lower(regexp_extract(l[i], '(?i)CN=([^/=]+)$', 1)) ELSE '' END AS login FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM sides)),
per AS (SELECT mail_id, address, any_value(ts) AS ts FROM pn GROUP BY 1, 2), cnt AS (SELECT address, count(*) AS message_count, min(ts) AS active_from, max(ts) AS active_to FROM per GROUP BY 1),
uses AS (SELECT address, name, count(*) AS uses FROM pn WHERE name <> '' GROUP BY 1, 2), nm AS (SELECT address, list(name ORDER BY uses DESC, name) AS names FROM uses GROUP BY 1),
lg AS (SELECT address, list_sort(list(DISTINCT login)) AS logins FROM pn WHERE login <> '' GROUP BY 1),
ro AS (SELECT cnt.*, coalesce(names, []) AS names, coalesce(logins, []) AS logins FROM cnt LEFT JOIN nm USING (address) LEFT JOIN lg USING (address))"""
_USABLE = "len(names) > 0 AND active_from IS NOT NULL AND active_to IS NOT NULL AND message_count >= 20"


@R.add(f"{_NAMED} SELECT mail_id, role, address, name, login, count(*) AS times FROM pn GROUP BY ALL")
def participant_names(spark, d):
    return people(spark, d).groupBy("mail_id", "role", "address", "name", "login").agg(F.count("*").alias("times"))


@R.add(f"{_NAMED} SELECT address, array_to_string(names, '|') AS names, array_to_string(logins, '|') AS logins FROM ro")
def roster_names(spark, d):
    return entries(spark, d).select("address", F.array_join("display_name_variants", "|").alias("names"), F.array_join("exchange_logins", "|").alias("logins"))


@R.add()
def header_addresses(spark, d):
    """Display names and addresses of From, To and Cc by the rules of mail addresses."""
    return roster.address_entries(mail(spark, d, "mail_from", "mail_to", "cc"), "mail_id", ["mail_from", "mail_to", "cc"])


@R.add("SELECT path, found FROM (VALUES ('message', true), ('mail_to', true), ('embedding', false), ('mail_from.name', false)) v(path, found)")
def schema_fields(spark, d):
    schema = table(spark, d, "mail").schema
    return spark.createDataFrame([(p, has_field(schema, p)) for p in ("message", "mail_to", "embedding", "mail_from.name")], "path string, found boolean")


@R.add(f"{_WITH}, {_PER} SELECT address, count(*) AS message_count, CAST(sum(sent) AS BIGINT) AS sent_count, CAST(sum(1 - sent) AS BIGINT) AS received_count, min(ts) AS active_from, max(ts) AS active_to, array_to_string(list_sort(list_distinct(list(custodian))), ',') AS custodians, ends_with(address, '@{DOMAIN}') AS internal FROM q GROUP BY 1")
def roster_entries(spark, d):
    return entries(spark, d).select("address", "message_count", "sent_count", "received_count", "active_from", "active_to", F.array_join("custodians", ",").alias("custodians"), "internal")


@R.add(f"{_WITH}, e AS (SELECT a.address, b.address AS other, count(DISTINCT a.mail_id) AS messages FROM p a JOIN p b ON a.mail_id = b.mail_id AND a.address <> b.address GROUP BY 1, 2) SELECT address, CAST(r AS INTEGER) AS rank, other, messages FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY messages DESC, other) AS r FROM e) WHERE r <= 5")
def cooccurrence_topn(spark, d):
    return roster.top_correspondents(people(spark, d))


_XN = r"trim(regexp_replace(trim(n), '^[\s,;''\"]+|[''\"\s]+$', '', 'g'))"


@R.add(rf"""SELECT mail_id, CAST(i AS INTEGER) AS pos, {_XN.replace('trim(n)', 'trim(names[i + 1])')} AS name, lower(regexp_extract(dns[i + 1], '(?i)CN=([^/=]+)$', 1)) AS login FROM (SELECT mail_id, names, dns, unnest(range(len(names))) AS i FROM (
SELECT DISTINCT mail_id, regexp_extract_all(x, '([^<>]*)<([^<>]*)>', 1) AS names, regexp_extract_all(x, '([^<>]*)<([^<>]*)>', 2) AS dns FROM (SELECT mail_id, trim(regexp_replace(x_to, '\s+', ' ', 'g')) AS x FROM mail WHERE x_to IS NOT NULL)))""")
def x_header(spark, d):
    return mail(spark, d, "x_to").select("mail_id", F.posexplode(roster.x_entries(F.col("x_to"))).alias("pos", "e")).select("mail_id", "pos", "e.name", "e.login")


@R.add(f"{_COUNTS} SELECT bucket, people FROM (SELECT count(*) FILTER (message_count = 1) AS b1, count(*) FILTER (message_count BETWEEN 2 AND 4) AS b2, count(*) FILTER (message_count BETWEEN 5 AND 9) AS b3, count(*) FILTER (message_count BETWEEN 10 AND 49) AS b4, count(*) FILTER (message_count >= 50) AS b5 FROM c), LATERAL (VALUES ('1', b1), ('2-4', b2), ('5-9', b3), ('10-49', b4), ('50+', b5)) v(bucket, people)")
def roster_histogram(spark, d):
    return roster.histogram(entries(spark, d), "message_count")


@R.add(f"{_COUNTS}, r AS (SELECT message_count, row_number() OVER (ORDER BY message_count) AS i, count(*) OVER () AS n FROM c) SELECT " + ", ".join(f"max(message_count) FILTER (i = greatest(1, least(n, round_even({p / 100} * n, 0)::BIGINT))) AS p{p}" for p in roster.PERCENTILES) + " FROM r")
def roster_percentiles(spark, d):
    return roster.percentiles(entries(spark, d), "message_count")


@R.add(f"{_COUNTS} SELECT count(*) AS people, count(*) FILTER (ends_with(address, '@{DOMAIN}')) AS internal, min(message_count) AS least, max(message_count) AS most, round(avg(message_count), 2) AS mean FROM c")
def roster_coverage(spark, d):
    return roster.coverage(entries(spark, d), 0).select("people", "internal", "least", "most", "mean")


@R.add(f"{_NAMED} SELECT count(*) AS usable, CASE WHEN count(*) >= 5 THEN 'go' ELSE 'no_go' END AS decision FROM ro WHERE {_USABLE}")
def roster_decision(spark, d):
    return roster.go_no_go(roster.coverage(entries(spark, d), 0))


@R.add(f"{_NAMED} SELECT count(*) AS people, count(*) FILTER (len(names) > 0) AS named, count(*) FILTER (len(logins) > 0) AS with_login, count(*) FILTER ({_USABLE}) AS usable, round(100e0 * count(*) FILTER (len(names) > 0) / count(*), 1) AS named_percent, round(100e0 * count(*) FILTER (len(logins) > 0) / count(*), 1) AS login_percent FROM ro")
def roster_shares(spark, d):
    return roster.coverage(entries(spark, d), 0).select("people", "named", "with_login", "usable", "named_percent", "login_percent")


_SQUEEZED = r"trim(regexp_replace(x, '[\s\x0B\x85\p{Z}]+', ' ', 'g'))"
_FILLED = "coalesce(list_filter(list_transform(list_transform(names, lambda x: " + _SQUEEZED + "), lambda n: ONE), lambda x: x <> '')[1], '')"
_SURNAME = _FILLED.replace("ONE", "CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) WHEN contains(n, ' ') THEN string_split(n, ' ')[-1] ELSE '' END")
_GIVEN = _FILLED.replace("ONE", "CASE WHEN contains(n, ',') THEN split_part(trim(regexp_replace(n, '^[^,]*,', '')), ' ', 1) WHEN contains(n, ' ') THEN split_part(n, ' ', 1) ELSE '' END")


@R.add(f"{_NAMED} SELECT address, {_SURNAME} AS surname, {_GIVEN} AS given FROM ro")
def roster_surnames(spark, d):
    names = F.col("display_name_variants")
    return entries(spark, d).select("address", roster.surname(names).alias("surname"), roster.given_name(names).alias("given"))


@R.add(f"{_NAMED} SELECT address, message_count, array_to_string(names, '|') AS names FROM ro WHERE {_USABLE}")
def usable_subjects(spark, d):
    return roster.usable(entries(spark, d)).select("address", "message_count", F.array_join("display_name_variants", "|").alias("names"))


def _name_forms_sql(source: str, columns: str) -> str:
    """SQL of (columns, forms): the forms of every `name` of source."""
    clean = lambda c: f"regexp_replace(trim(regexp_replace({c}, '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g')), '^[''\"]+|[''\"]+$', '', 'g')"
    more = "CASE WHEN len(w) > 1 THEN [w[1] || ' ' || w[-1], w[1][1] || ' ' || w[-1], w[1][1] || '. ' || w[-1], array_to_string(list_transform(w, lambda x: x[1]), ''), array_to_string(list_transform(w, lambda x: x[1]), '.') || '.'] ELSE [] END"
    return f"""SELECT {columns}, CASE WHEN v <> '' AND len(w) > 0 THEN list_sort(list_distinct(list_filter([v, turned, w[1], w[-1]] || {more}, lambda x: x IS NOT NULL))) ELSE [] END AS forms FROM (
SELECT *, list_filter(string_split_regex(coalesce(turned, replace(v, ',', ' ')), ' +'), lambda x: x <> '') AS w FROM (SELECT *, CASE WHEN b <> '' AND a <> '' THEN a || ' ' || b END AS turned FROM (
SELECT *, {clean("regexp_extract(v, '^([^,]*),(.*)$', 1)")} AS b, {clean("regexp_extract(v, '^([^,]*),(.*)$', 2)")} AS a FROM (SELECT *, {clean("name")} AS v FROM {source}))))"""


_LOGIN_FORMS = "list_distinct([l] || CASE WHEN len(w) >= 2 THEN [w[1] || '.' || w[-1], w[1] || '_' || w[-1], w[1] || w[-1], w[1][1] || w[-1], w[-1] || w[1][1]] ELSE [] END)"
_FORMS = f"""{_NAMED}, fm AS (SELECT DISTINCT address, variant, kind FROM (
SELECT address, unnest(forms) AS variant, 'name' AS kind FROM ({_name_forms_sql("(SELECT address, unnest(names) AS name FROM ro)", "address")}) UNION ALL
SELECT address, unnest(logins || {_LOGIN_FORMS}), 'login' FROM (SELECT address, logins, split_part(address, '@', 1) AS l, list_filter(string_split_regex(split_part(address, '@', 1), '[._-]+'), lambda x: x <> '') AS w FROM ro)) WHERE length(variant) >= 3),
nn AS (SELECT address, lower(regexp_replace(trim(regexp_replace(name, '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g')), '^[''"]+|[''"]+$', '', 'g')) AS name FROM (SELECT address, unnest(names) AS name FROM ro)),
me AS (SELECT '{SUBJECT}' AS address UNION SELECT address FROM nn WHERE name <> '' AND name IN (SELECT name FROM nn WHERE address = '{SUBJECT}' AND name <> ''))"""


@R.add(f"{_FORMS} SELECT lower(variant) AS variant, array_to_string(list_sort(list(DISTINCT address)), '|') AS owners, CAST(count(DISTINCT address) AS INTEGER) AS n FROM fm GROUP BY 1")
def variant_owners(spark, d):
    return alias.variant_owners(alias.entry_forms(entries(spark, d))).select("variant", F.array_join("owners", "|").alias("owners"), "n")


@R.add(f"""{_FORMS}, own AS (SELECT variant, kind FROM fm WHERE address IN (SELECT address FROM me) UNION ALL SELECT address, 'address' FROM me)
SELECT variant, min(kind) AS kind, lower(variant) NOT IN (SELECT lower(variant) FROM fm WHERE address NOT IN (SELECT address FROM me)) AS is_label FROM own GROUP BY variant""")
def alias_set(spark, d):
    return alias.alias_set(entries(spark, d), SUBJECT)


@R.add(f"{_FORMS} SELECT address FROM me")
def related_addresses(spark, d):
    return alias.related_addresses(entries(spark, d), SUBJECT)


@R.add(r"""SELECT address, array_to_string(list_sort(list_distinct([l] || CASE WHEN len(w) >= 2 THEN [w[1] || '.' || w[-1], w[1] || '_' || w[-1], w[1] || w[-1], w[1][1] || w[-1], w[-1] || w[1][1]] ELSE [] END)), '|') AS forms FROM (
SELECT address, split_part(address, '@', 1) AS l, list_filter(string_split_regex(split_part(address, '@', 1), '[._-]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(mail_from), '([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})', 1)) AS address FROM mail))""")
def login_forms(spark, d):
    return mail(spark, d, "mail_from").select(F.explode(roster.addresses(F.col("mail_from"), False)).alias("address")).distinct().select("address", F.array_join(alias.login_forms(F.col("address")), "|").alias("forms"))


@R.add("SELECT name, array_to_string(forms, '|') AS forms FROM (" + _name_forms_sql(rf"(SELECT DISTINCT name FROM (SELECT {_TIDY.format('unnest(names)')} AS name FROM (SELECT regexp_extract_all({_FLAT.format('x_to')}, {_ENTRY}, 1) AS names FROM mail WHERE x_to IS NOT NULL)) WHERE name <> '')", "name") + ")")
def name_forms(spark, d):
    names = mail(spark, d, "x_to").select(F.explode(roster.x_entries(F.col("x_to"))).alias("e")).select("e.name").filter("name <> ''").distinct()
    return names.select("name", F.array_join(alias.name_forms(F.col("name")), "|").alias("forms"))


# -- captions and references

def all_captions(spark: SparkSession, d: str) -> DataFrame:
    return captions.captions_of(table(spark, d, "clusters"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _caption_sql() -> str:
    """SQL of (cluster_id, pos, party, organisation, surname, given), the folds as list expressions."""
    replaced = lambda c, pattern, by: f"regexp_replace({c}, {_q(pattern)}, '{by}', 'g')"
    tidy = lambda p: replaced(replaced(replaced(replaced(replaced(replaced(p, captions._ROLE, " "), r"[\s\-]{2,}", " "), captions._EDGE, ""), r"(?i)^(?:the|a|an)\s+", ""), captions._SUFFIX, ""), captions._EDGE, "")
    words = lambda c: f"list_filter(list_transform(string_split_regex({c}, '[\\s,]+'), lambda w: {replaced('w', '^[.,;' + chr(39) + chr(34) + ']+|[.,;' + chr(39) + chr(34) + ']+$', '')}), lambda w: w <> '')"
    listed = lambda names: "[" + ", ".join(_q(n) for n in names) + "]"
    flat = replaced(r"trim(regexp_replace(caption, '\s+', ' ', 'g'))", r"(?i)^\s*(?:in\s+re|ex\s+parte|matter\s+of|estate\s+of)\b[:\s]*", "")
    pieces = "string_split_regex(" + flat + ", " + _q(r"(?i)\s+vs?\.?\s+|[,;]?\s*\bex\s+rel(?:atione)?\.?\s+") + ")"
    return f"""WITH c AS (SELECT cluster_id, max(coalesce(CASE WHEN trim(case_name_full) <> '' THEN case_name_full END, CASE WHEN trim(case_name) <> '' THEN case_name END, CASE WHEN trim(case_name_short) <> '' THEN case_name_short END)) AS caption FROM clusters GROUP BY 1),
p AS (SELECT cluster_id, list_filter(list_transform({pieces}, lambda x: {tidy("x")}), lambda x: x <> '') AS ps FROM c WHERE caption IS NOT NULL),
e AS (SELECT cluster_id, unnest(range(len(ps))) AS pos, unnest(ps) AS party FROM p),
s AS (SELECT *, {words("party")} AS ws, list_transform(list_filter(list_transform(string_split(party, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: {words("x")}) AS segs FROM e),
m AS (SELECT *, list_transform(segs, lambda g: coalesce(list_position(list_transform(g, lambda w: list_contains({listed(captions.INSTITUTIONS)}, lower(w))), true), 0)) AS marks FROM s),
i AS (SELECT *, coalesce(list_position(list_transform(marks, lambda x: x > 0), true), 0) AS cut FROM m),
k AS (SELECT *, CASE WHEN cut = 0 THEN flatten(segs) WHEN len(flatten(segs[1:cut - 1])) = 0 AND marks[cut] >= 3 THEN segs[cut][1:marks[cut] - 1] ELSE flatten(segs[1:cut - 1]) END AS person FROM i),
o AS (SELECT *, len(list_filter(ws, lambda w: list_contains({listed(captions.CORPORATE)}, lower(w)))) > 0 OR coalesce(len(person), 0) = 0 AS organisation FROM k)
SELECT cluster_id, CAST(pos AS INTEGER) AS pos, party, organisation,
CASE WHEN NOT organisation AND length(person[-1]) >= 4 AND NOT list_contains({listed((*captions.INSTITUTIONS, *captions.CORPORATE))}, lower(person[-1])) AND regexp_matches(person[-1], '^[A-Za-z][A-Za-z''\\-]+$') THEN person[-1] ELSE '' END AS surname,
CASE WHEN NOT organisation AND len(person) >= 2 AND regexp_matches(person[1], '^[A-Z][a-z]{{2,}}$') THEN person[1] ELSE '' END AS given FROM o"""


@R.add(_caption_sql())
def caption_parties(spark, d):
    return captions.caption_parties(all_captions(spark, d), "cluster_id", "caption")


@R.add(r"SELECT cluster_id, CAST(len(list_filter(string_split_regex(trim(regexp_replace(caption, '\s+', ' ', 'g')), '(?i)\s+vs?\.?\s+'), lambda x: trim(x) <> '')) AS INTEGER) AS sides FROM (SELECT cluster_id, max(coalesce(CASE WHEN trim(case_name_full) <> '' THEN case_name_full END, CASE WHEN trim(case_name) <> '' THEN case_name END, CASE WHEN trim(case_name_short) <> '' THEN case_name_short END)) AS caption FROM clusters GROUP BY 1) WHERE caption IS NOT NULL")
def caption_sides(spark, d):
    flat = F.trim(F.regexp_replace("caption", r"\s+", " "))
    return all_captions(spark, d).select("cluster_id", F.size(F.filter(F.split(flat, r"(?i)\s+vs?\.?\s+", -1), lambda x: F.trim(x) != "")).alias("sides"))


_REF = suitability.REFERENCE[len("(?iuU)"):]


def _spans_sql(source: str) -> str:
    """SQL of the reference spans of (id, t): offsets from gaps and matches, merged by running islands."""
    ref = _REF.replace("'", "''")
    return f"""s AS (SELECT id, t, regexp_extract_all(t, '(?i)({ref})', 1) AS h, string_split_regex(t, '(?i)(?:{ref})') AS g FROM {source} WHERE t IS NOT NULL),
u AS (SELECT id, t, h, g, unnest(range(1, len(h) + 1)) AS i FROM s WHERE len(h) > 0),
v AS (SELECT id, t, i, length(h[i]) AS n, sum(length(g[i])) OVER (PARTITION BY id ORDER BY i) + coalesce(sum(length(h[i])) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u),
w AS (SELECT *, a + n AS b, sum(CASE WHEN i = 1 OR a - prev > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS island FROM (SELECT *, lag(a + n) OVER (PARTITION BY id ORDER BY i) AS prev FROM v)),
x AS (SELECT id, any_value(t) AS t, min(a)::BIGINT AS start, max(b)::BIGINT AS stop FROM w GROUP BY id, island),
y AS (SELECT *, substring(t, greatest(1, start - 139), stop + 140 - greatest(0, start - 140)) AS win FROM x),
z AS (SELECT id, start, stop, substring(t, start + 1, stop - start) AS phrase, len(regexp_extract_all(win, '[A-Z][A-Za-z.''\\-]+,\\s+[A-Z][A-Za-z.''\\-]+')) >= 3 OR length(win) - length(replace(win, ';', '')) >= 3 OR regexp_matches(win, '(?i)(?:From:|To:|Cc:|Sent:|Subject:|-----Original Message-----|Forwarded by|DL-|@\\w+\\.(?:com|org|net))') AS listed FROM y)"""


_LOGS = "(SELECT DISTINCT log_id AS id, message AS t FROM logs)"


@R.add(f"WITH {_spans_sql(_LOGS)} SELECT id AS log_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, phrase, listed FROM z")
def references(spark, d):
    return suitability.references(one_per_key(table(spark, d, "logs", "log_id", "message"), "log_id", ["message"]), "log_id", "message")


@R.add(f"WITH {_spans_sql(_LOGS)} SELECT count(*) AS scanned, count(*) FILTER (p + l > 0) AS describing, count(*) FILTER (p > 0) AS prose_docs, CAST(sum(p) AS BIGINT) AS prose, CAST(sum(l) AS BIGINT) AS listed, round(sum(p + l) / count(*), 6) AS density, round(sum(p) / sum(p + l), 6) AS prose_share, CASE WHEN sum(p + l) / count(*) >= 1.0 THEN 'rich' WHEN sum(p + l) / count(*) < 0.05 THEN 'absent' ELSE 'sparse' END AS band FROM (SELECT r.id, count(z.id) FILTER (NOT z.listed) AS p, count(z.id) FILTER (z.listed) AS l FROM {_LOGS} r LEFT JOIN z ON z.id = r.id WHERE trim(r.t) <> '' GROUP BY 1)")
def assess(spark, d):
    return suitability.assess(one_per_key(table(spark, d, "logs", "log_id", "message"), "log_id", ["message"]), "log_id", "message").drop("reasons")


@R.add(f"WITH {_spans_sql('(SELECT DISTINCT opinion_id AS id, message AS t FROM opinions)')} SELECT lower(phrase) AS phrase, count(*) AS uses FROM z GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_phrases(spark, d):
    return suitability.phrases(one_per_key(table(spark, d, "opinions", "opinion_id", "message"), "opinion_id", ["message"]), "opinion_id", "message")


def _mentions_sql(surname: str, house: str) -> str:
    """SQL of (mail_id, descriptive, listed): mentions told apart by the 120 characters on either side."""
    heads = f"(?i)(?:From:|To:|Cc:|Sent:|Subject:|-----Original Message-----|Forwarded by|DL-|@{house}|/{house})"
    return f"""s AS (SELECT mail_id, t, regexp_extract_all(t, '(?i)({surname})', 1) AS h, string_split_regex(t, '(?i)(?:{surname})') AS g FROM (SELECT mail_id, any_value(message) AS t FROM mail GROUP BY mail_id) WHERE t IS NOT NULL),
u AS (SELECT mail_id, t, h, g, unnest(range(1, len(h) + 1)) AS i FROM s WHERE len(h) > 0),
v AS (SELECT mail_id, t, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + length(h[1]) * (i - 1) AS BIGINT) AS a, length(h[i]) AS n FROM u),
w AS (SELECT mail_id, substring(t, greatest(1, a - 119), a + n + 120 - greatest(0, a - 120)) AS win FROM v),
z AS (SELECT mail_id, len(regexp_extract_all(win, '[A-Z][A-Za-z.''\\-]+,\\s+[A-Z][A-Za-z.''\\-]+')) >= 3 OR length(win) - length(replace(win, ';', '')) >= 3 OR regexp_matches(win, '{heads}') AS listed FROM w),
mt AS (SELECT mail_id, CAST(count(*) FILTER (NOT listed) AS INTEGER) AS descriptive, CAST(count(*) FILTER (listed) AS INTEGER) AS listed FROM z GROUP BY mail_id)"""


@R.add(f"WITH {_mentions_sql('Dravane', HOUSE)} SELECT mail_id, descriptive, listed FROM mt")
def mentions(spark, d):
    return suitability.mentions(mail(spark, d, "message"), "mail_id", "message", "Dravane", HOUSE)


@R.add(f"SELECT s AS surname_hits, f AS full_hits, round(s / greatest(f, 1), 6) AS ratio, s / greatest(f, 1) >= 8.0 AS rejected FROM (SELECT count(*) FILTER (contains({LINE.format('message')}, ' dravane ')) AS s, count(*) FILTER (contains({LINE.format('message')}, ' quenby dravane ')) AS f FROM (SELECT DISTINCT mail_id, message FROM mail))")
def screen(spark, d):
    return suitability.screen(mail(spark, d, "message"), "message", "Quenby", "Dravane")


@R.add(rf"""WITH {_mentions_sql('Dravane', HOUSE)}, dg AS (SELECT mail_id, sha1(substring(trim(regexp_replace(any_value(message), '[\s\x0B\x85\p{{Z}}]+', ' ', 'g')), 1, 300)) AS digest FROM mail GROUP BY mail_id)
SELECT count(*) AS documents, count(*) FILTER (descriptive > 0) AS descriptive, count(*) FILTER (descriptive = 0) AS list_only, count(DISTINCT CASE WHEN descriptive > 0 THEN digest END) AS distinct_descriptive FROM mt JOIN dg USING (mail_id)""")
def subject_profile(spark, d):
    return suitability.profile(mail(spark, d, "message"), "mail_id", "message", "Dravane", HOUSE)


@R.add()
def rank_subjects(spark, d):
    names = all_captions(spark, d)
    subjects = captions.caption_parties(names, "cluster_id", "caption").filter("surname <> ''").select("surname").distinct()
    opinions = one_per_key(table(spark, d, "opinions", "opinion_id", "message"), "opinion_id", ["message"])
    return suitability.rank_subjects(opinions, "opinion_id", "message", subjects, HOUSE)
