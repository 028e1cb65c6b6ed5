"""Queries of retrieval and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import captions, retrieval
from ..sources.tables import table
from .registry import Registry

R = Registry()
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
LINE = r"(' ' || array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ')"
WORDS, BOOSTED = "audit retention deletion", ("erase records", "signed deletion plan of the controller")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def bm25_sql(boosts: dict[str, float], source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """SQL that scores every document with a term; (id, score)."""
    terms = ", ".join(f"('{w}', {b:.1f}e0)" for w, b in sorted(boosts.items()))
    return f"""WITH t AS MATERIALIZED (SELECT {key} AS id, coalesce({TOK.format(text)}, []) AS toks FROM {source}), s AS MATERIALIZED (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
p AS MATERIALIZED (SELECT id, len(toks) AS dl, q.term, q.boost, len(list_filter(toks, lambda x: x = q.term)) AS tf FROM t, (VALUES {terms}) q(term, boost)), f AS MATERIALIZED (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY term)
SELECT id, round(sum(boost * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY id"""


def top_sql(inner: str, size: int) -> str:
    return f"SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({inner}) ORDER BY score DESC, id LIMIT {size}"


LEX = {w: 1.0 for w in retrieval.query_terms(WORDS)}
BOOST = retrieval.boosted_terms(*BOOSTED)
KNN_SQL = """SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 6) AS score
FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q WHERE len(e.embedding) = len(q.v)"""


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings", "vec_id", "embedding").orderBy("vec_id").first().embedding)


@R.add(top_sql(bm25_sql(LEX), 20))
def bm25_topk(spark, d):
    return retrieval.top(retrieval.bm25(docs(spark, d), LEX, "doc_id", "text"), 20)


@R.add(top_sql(bm25_sql(BOOST), 50))
def bm25_boosted(spark, d):
    return retrieval.top(retrieval.bm25(docs(spark, d), BOOST, "doc_id", "text"), 50)


@R.add(top_sql(KNN_SQL, 50))
def knn_cosine(spark, d):
    return retrieval.top(retrieval.knn(table(spark, d, "embeddings"), query_vector(spark, d)), 50)


_A, _B = top_sql(bm25_sql(LEX), 50), top_sql(KNN_SQL, 50)
_RRF = f"SELECT coalesce(a.id, b.id) AS id, round(coalesce(1e0 / (60 + a.rank), 0) + coalesce(1e0 / (60 + b.rank), 0), 9) AS score FROM ({_A}) a FULL JOIN ({_B}) b ON a.id = b.id"
_SCALED = "SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1e0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM ({})"
_MINMAX = f"SELECT coalesce(a.id, b.id) AS id, round((coalesce(a.s, 0e0) * 0.5 + coalesce(b.s, 0e0) * 0.5) / 1.0, 6) AS score FROM ({_SCALED.format(_A)}) a FULL JOIN ({_SCALED.format(_B)}) b ON a.id = b.id"


@R.add(top_sql(_RRF, 50))
def hybrid_rrf(spark, d):
    a = retrieval.top(retrieval.bm25(docs(spark, d), LEX, "doc_id", "text"), 50)
    return retrieval.top(retrieval.rrf(a, retrieval.top(retrieval.knn(table(spark, d, "embeddings"), query_vector(spark, d)), 50)), 50)


@R.add(top_sql(_MINMAX, 50))
def hybrid_minmax(spark, d):
    a = retrieval.top(retrieval.bm25(docs(spark, d), LEX, "doc_id", "text"), 50)
    return retrieval.top(retrieval.min_max(a, retrieval.top(retrieval.knn(table(spark, d, "embeddings"), query_vector(spark, d)), 50)), 50)


@R.add(top_sql(bm25_sql(retrieval.boosted_terms(BOOSTED[1], BOOSTED[1])), 50))
def discover_fallback(spark, d):
    return retrieval.discover(docs(spark, d), BOOSTED[1])


@R.add(top_sql(_RRF.replace(_A, top_sql(bm25_sql(retrieval.boosted_terms(WORDS, WORDS)), 50)), 50))
def discover_hybrid(spark, d):
    return retrieval.discover(docs(spark, d), WORDS, vectors=table(spark, d, "embeddings"), query=query_vector(spark, d))


@R.add(f"SELECT c.id AS doc_id, 'documents' AS index, c.score, d.created_at AS timestamp, d.text FROM ({top_sql(bm25_sql(LEX), 20)}) c JOIN documents d ON d.doc_id = c.id")
def project_candidates(spark, d):
    ranked = retrieval.top(retrieval.bm25(docs(spark, d), LEX, "doc_id", "text"), 20)
    return retrieval.candidates(ranked, table(spark, d, "documents", "doc_id", "text", "created_at"), "doc_id", "text", "documents", F.col("created_at"))


@R.add("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t, doc_kind = 'request' AS f FROM documents),
s AS (SELECT count(*) AS n, count(*) FILTER (f) AS nf FROM d), x AS (SELECT term, count(*) FILTER (f) AS fg, count(*) AS bg FROM (SELECT f, unnest(t) AS term FROM d) GROUP BY term)
SELECT term, fg, bg, round((fg / nf - bg / n) * ((fg / nf) / (bg / n)), 6) AS score FROM x, s WHERE fg >= 3 AND fg / nf > bg / n ORDER BY score DESC, term LIMIT 30""")
def significant_terms(spark, d):
    all_docs = table(spark, d, "documents", "doc_id", "text", "doc_kind")
    return retrieval.significant_terms(all_docs, all_docs.filter("doc_kind = 'request'"), "doc_id", "text", drop_duplicates=False)


_DIGEST = r"sha1(substring(trim(regexp_replace(text, '[\s\x0B\x85\p{Z}]+', ' ', 'g')), 1, 300))"
_UNIQUE = f"""u AS (SELECT doc_id, text, doc_kind FROM (SELECT *, row_number() OVER (PARTITION BY {_DIGEST} ORDER BY CASE WHEN doc_kind = 'request' THEN 0 ELSE 1 END, doc_id) AS nth FROM documents) WHERE nth = 1),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t, coalesce(doc_kind = 'request', false) AS f FROM u),
s AS (SELECT count(*) AS n, count(*) FILTER (f) AS nf FROM d), x AS (SELECT term, count(*) FILTER (f) AS fg, count(*) AS bg FROM (SELECT f, unnest(t) AS term FROM d) GROUP BY term),
sig AS (SELECT term, fg, bg, round((fg / nf - bg / n) * ((fg / nf) / (bg / n)), 6) AS score FROM x, s WHERE fg >= 3 AND fg / nf > bg / n ORDER BY score DESC, term LIMIT 30)"""


@R.add(f"WITH {_UNIQUE} SELECT term, fg, bg, score FROM sig")
def significant_terms_unique(spark, d):
    """Near-duplicate texts counted once, as the operator does by default."""
    all_docs = table(spark, d, "documents", "doc_id", "text", "doc_kind")
    return retrieval.significant_terms(all_docs, all_docs.filter("doc_kind = 'request'"), "doc_id", "text")


@R.add("SELECT doc_id, n_chars FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 500")
def hash_sample(spark, d):
    return retrieval.hash_sample(table(spark, d, "documents", "doc_id", "n_chars"), "doc_id", 500)


@R.add("SELECT doc_id, coalesce(text, '') AS text, created_at FROM documents")
def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "created_at")


@R.add("SELECT mail_id, mail_from, custodian, ts FROM mail")
def header_scan(spark, d):
    return table(spark, d, "mail", "mail_id", "mail_from", "custodian", "ts")


@R.add("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def term_filter(spark, d):
    return table(spark, d, "documents", "doc_id", "source", "lang").filter("lang = 'en'").select("doc_id", "source")


@R.add("SELECT DISTINCT mail_id FROM mail WHERE len(list_filter(coalesce(mail_to, []), lambda x: contains(lower(x), 'dravane'))) > 0")
def contains_filter(spark, d):
    return table(spark, d, "mail", "mail_id", "mail_to").filter(F.exists("mail_to", lambda x: F.contains(F.lower(x), F.lit("dravane")))).select("mail_id").distinct()


@R.add(f"SELECT doc_id FROM documents WHERE contains({LINE.format('text')}, ' retention plan ')")
def phrase_match(spark, d):
    return docs(spark, d).filter(tx.has_phrase(F.col("text"), "Retention plan")).select("doc_id")


@R.add(f"SELECT doc_id, (CASE WHEN contains({LINE.format('text')}, ' retention plan ') THEN 1 ELSE 0 END + CASE WHEN contains({LINE.format('text')}, ' data subject ') THEN 1 ELSE 0 END) AS clauses FROM documents WHERE contains({LINE.format('text')}, ' retention plan ') OR contains({LINE.format('text')}, ' data subject ')")
def bool_should(spark, d):
    one, two = tx.has_phrase(F.col("text"), "retention plan"), tx.has_phrase(F.col("text"), "data subject")
    return docs(spark, d).filter(one | two).select("doc_id", (one.cast("int") + two.cast("int")).alias("clauses"))


@R.add("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def fetch_texts(spark, d):
    ids = table(spark, d, "embeddings", "vec_id", "label").filter("label = 1").select(F.col("vec_id").alias("doc_id"))
    return docs(spark, d).join(ids, "doc_id", "left_semi")


@R.add(r"SELECT doc_id, trim(regexp_replace(CASE WHEN contains(text, '<') THEN regexp_replace(text, '<[^>]+>', ' ', 'g') ELSE text END, '[\s\x0B\x85\p{Z}]+', ' ', 'g')) AS body FROM documents WHERE trim(text) <> ''")
def body_text(spark, d):
    return docs(spark, d).select("doc_id", tx.strip_tags(tx.first_filled(F.col("text"))).alias("body")).filter("body is not null")


@R.add(r"SELECT count(DISTINCT sha1(substring(trim(regexp_replace(text, '[\s\x0B\x85\p{Z}]+', ' ', 'g')), 1, 300))) AS distinct_texts FROM documents")
def near_dup_count(spark, d):
    return docs(spark, d).agg(F.countDistinct(tx.near_dup_key(F.col("text"))).alias("distinct_texts"))


_HALF = "CASE WHEN instr(substring(m, CAST(floor(length(m) / 2) AS BIGINT) + 1), '. ') > 0 AND length(m) - (CAST(floor(length(m) / 2) AS BIGINT) + instr(substring(m, CAST(floor(length(m) / 2) AS BIGINT) + 1), '. ')) - 1 >= 200 THEN CAST(floor(length(m) / 2) AS BIGINT) + instr(substring(m, CAST(floor(length(m) / 2) AS BIGINT) + 1), '. ') + 1 ELSE CAST(floor(length(m) / 2) AS BIGINT) END"


@R.add(f"SELECT DISTINCT opinion_id, trim(substring(m, 1, cut)) AS a, trim(substring(m, cut + 1)) AS b FROM (SELECT opinion_id, m, {_HALF} AS cut FROM (SELECT opinion_id, message AS m FROM opinions WHERE message IS NOT NULL))")
def split_halves(spark, d):
    return table(spark, d, "opinions", "opinion_id", "message").filter("message is not null").select("opinion_id", tx.split_halves(F.col("message")).alias("h")).select("opinion_id", "h.a", "h.b").distinct()


_FLAT = r"trim(regexp_replace(message, '[\s\x0B\x85\p{Z}]+', ' ', 'g'))"
_RF = "CASE WHEN instr(reverse(h), reverse('{0}')) = 0 THEN -1 ELSE length(h) - instr(reverse(h), reverse('{0}')) - length('{0}') + 1 END"


@R.add(f"""SELECT DISTINCT mail_id, CASE WHEN length(f) <= 400 THEN f WHEN mk > 133 THEN trim(substring(h, 1, mk)) WHEN bl > 0 THEN substring(h, 1, bl) || ' ...' ELSE h || ' ...' END AS body FROM (
SELECT mail_id, f, h, greatest({_RF.format('-----Original Message-----')}, {_RF.format('Forwarded by')}) AS mk, {_RF.format(' ')} AS bl FROM (SELECT mail_id, f, substring(f, 1, 400) AS h FROM (SELECT mail_id, {_FLAT} AS f FROM mail WHERE message IS NOT NULL)))""")
def clean_body(spark, d):
    return table(spark, d, "mail", "mail_id", "message").filter("message is not null").select("mail_id", tx.clean_body(F.col("message"), 400, ("-----Original Message-----", "Forwarded by")).alias("body")).distinct()


@R.add("SELECT opinion_id, caption FROM (SELECT DISTINCT opinion_id, cluster_id FROM opinions) o JOIN (SELECT cluster_id, max(coalesce(CASE WHEN trim(case_name_full) <> '' THEN case_name_full END, CASE WHEN trim(case_name) <> '' THEN case_name END, CASE WHEN trim(case_name_short) <> '' THEN case_name_short END)) AS caption FROM clusters GROUP BY 1) c USING (cluster_id) WHERE caption IS NOT NULL")
def caption_lookup(spark, d):
    return table(spark, d, "opinions", "opinion_id", "cluster_id").distinct().join(captions.captions_of(table(spark, d, "clusters")), "cluster_id").select("opinion_id", "caption")


@R.add("SELECT subject_id, count(*) AS opinions FROM (SELECT DISTINCT opinion_id, subject_id FROM opinions WHERE half = 'a') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def subject_counts(spark, d):
    return table(spark, d, "opinions", "opinion_id", "subject_id", "half").filter("half = 'a'").select("opinion_id", "subject_id").distinct().groupBy("subject_id").agg(F.count("*").alias("opinions")).orderBy(F.desc("opinions"), "subject_id").limit(50)


@R.add("SELECT doc_id, 'm-' || substring(sha1('veilstone/masked/v1:' || doc_id), 1, 12) AS masked_id, regexp_matches('m-' || substring(sha1('veilstone/masked/v1:' || doc_id), 1, 12), '^m-[0-9a-f]{12}$') AS opaque FROM documents")
def opaque_ids(spark, d):
    return docs(spark, d).select("doc_id", tx.masked_id(F.col("doc_id"), "veilstone/masked/v1").alias("masked_id")).withColumn("opaque", tx.is_opaque_id(F.col("masked_id")))


@R.add("SELECT DISTINCT log_id, message, service, lower(level) AS level, ts FROM logs WHERE lower(level) IN ('error', 'warn')")
def log_filter(spark, d):
    return table(spark, d, "logs").filter(F.lower("level").isin("error", "warn")).select("log_id", "message", "service", F.lower("level").alias("level"), "ts").distinct()


@R.add("SELECT 'mail' AS _index, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT mail_id FROM mail) UNION ALL SELECT 'opinions', count(*) FROM (SELECT DISTINCT opinion_id FROM opinions) UNION ALL SELECT 'logs', count(*) FROM (SELECT DISTINCT log_id FROM logs)")
def index_union(spark, d):
    parts = [table(spark, d, t, k).select(F.lit(t).alias("_index"), F.col(k).alias("id")) for t, k in (("mail", "mail_id"), ("opinions", "opinion_id"), ("logs", "log_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("_index").agg(F.countDistinct("id").alias("n"))


@R.add("SELECT DISTINCT cluster_id, try_strptime(trim(date_filed), '%Y-%m-%d')::DATE::VARCHAR AS filed FROM clusters WHERE regexp_full_match(trim(date_filed), '\\d{4}-\\d{2}-\\d{2}')")
def iso_dates(spark, d):
    day = F.trim("date_filed")
    return table(spark, d, "clusters", "cluster_id", "date_filed").filter(day.rlike(r"^\d{4}-\d{2}-\d{2}$")).select("cluster_id", F.expr("try_to_date(trim(date_filed), 'yyyy-MM-dd')").cast("string").alias("filed")).distinct()
