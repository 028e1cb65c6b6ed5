"""Queries of the measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judge, metrics, retrieval
from ..operators.dedupe import one_per_key
from ..session import written
from ..sources import synthetic
from ..sources.tables import table
from .erasure import _EV, evaluations
from .people import HOUSE, _mentions_sql
from .registry import Registry
from .search import _UNIQUE, KNN_SQL, LEX, WORDS, bm25_sql, top_sql

R = Registry()
_DIGITS = "('0','2','4','6','8','a','c','e')"
_POS = "pos AS (SELECT doc_id FROM documents WHERE doc_kind = 'request')"
_RANK = f"rk AS ({top_sql(bm25_sql(LEX), 500)})"


def wilson_sql(h: str, n: str) -> str:
    p, z = f"(CAST({h} AS DOUBLE) / {n})", "1.96e0"
    spread = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4e0 * {n} * {n}))"
    low = f"round(100 * greatest(0e0, ({p} + {z} * {z} / (2e0 * {n}) - {spread}) / (1 + {z} * {z} / {n})), 1)"
    high = f"round(100 * least(1e0, ({p} + {z} * {z} / (2e0 * {n}) + {spread}) / (1 + {z} * {z} / {n})), 1)"
    return f"CASE WHEN {n} > 0 THEN {low} ELSE 0e0 END AS low, CASE WHEN {n} > 0 THEN {high} ELSE 0e0 END AS high"


def positives(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "doc_kind").filter("doc_kind = 'request'").select("doc_id")


def ranking(spark: SparkSession, d: str, size: int = 500) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return retrieval.top(retrieval.bm25(docs, LEX, "doc_id", "text"), size).withColumnRenamed("id", "doc_id")


@R.add(f"WITH {_POS} SELECT doc_id, substring(sha1('derive/v1:' || doc_id), 40, 1) IN {_DIGITS} AS derive FROM pos")
def split_positives(spark, d):
    return positives(spark, d).select("doc_id", metrics.in_derive_half(F.col("doc_id")).alias("derive"))


@R.add(f"SELECT doc_kind, hits, n, {wilson_sql('hits', 'n')} FROM (SELECT doc_kind, count(*) FILTER (lang = 'en') AS hits, count(*) AS n FROM documents GROUP BY 1)")
def wilson_intervals(spark, d):
    one = table(spark, d, "documents", "doc_kind", "lang").groupBy("doc_kind").agg(F.count_if(F.col("lang") == "en").alias("hits"), F.count("*").alias("n"))
    return one.select("doc_kind", "hits", "n", metrics.wilson(F.col("hits"), F.col("n")).alias("w")).select("doc_kind", "hits", "n", "w.low", "w.high")


_KS = ", ".join(f"({k})" for k in metrics.KS)


@R.add(f"WITH {_POS}, {_RANK} SELECT CAST(k AS INTEGER) AS k, found, n AS of, round(100e0 * found / n, 1) AS percent, {wilson_sql('found', 'n')}, k < n AS capped FROM (SELECT k, count(*) FILTER (rank <= k) AS found, count(*) AS n FROM (VALUES {_KS}) t(k), (SELECT p.doc_id, r.rank FROM pos p LEFT JOIN rk r ON r.id = p.doc_id) GROUP BY k)")
def recall_at_k(spark, d):
    return metrics.recall_at_k(ranking(spark, d), positives(spark, d), list(metrics.KS))


@R.add(f"WITH {_EV}, {_POS}, f AS (SELECT CAST(doc_id AS BIGINT) AS doc_id FROM ev WHERE is_identifiable AND coalesce(confidence_score, 0) >= 0.75) SELECT *, round(true_positives / nullif(flagged, 0), 3) AS precision, round(true_positives / nullif(positives, 0), 3) AS recall, round(1000e0 * (flagged - true_positives) / n, 2) AS false_per_1000 FROM (SELECT (SELECT count(*) FROM f) AS flagged, (SELECT count(*) FROM pos) AS positives, (SELECT count(*) FROM f JOIN pos USING (doc_id)) AS true_positives, (SELECT count(*) FROM documents) AS n)".replace("SELECT *, round(true", "SELECT flagged, positives, true_positives, round(true"))
def precision_recall(spark, d):
    from ..operators.judge import flagged_at

    flagged = flagged_at(evaluations(spark, d), 0.75).select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return metrics.precision_recall(flagged, positives(spark, d), table(spark, d, "documents", "doc_id").count())


@R.add(f"WITH {_EV}, x AS (SELECT d.source AS category, e.is_identifiable AND coalesce(e.confidence_score, 0) >= 0.75 AS f FROM documents d JOIN ev e ON e.doc_id = CAST(d.doc_id AS VARCHAR) WHERE d.source IS NOT NULL) SELECT category, count(*) AS judged, count(*) FILTER (f) AS flagged, round(count(*) FILTER (f) / count(*), 3) AS rate FROM x GROUP BY 1")
def per_category(spark, d):
    from ..operators.judge import flagged_at

    ev = evaluations(spark, d)
    decoys = table(spark, d, "documents", "doc_id", "source").filter("source is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("category"))
    return metrics.per_category(decoys, ev, flagged_at(ev, 0.75))


_SN = "list_filter([substring(text, 1, 12), substring(text, 40, 8), 'Zz absent'], lambda x: x IS NOT NULL AND x <> '')"


def clean(spark: SparkSession, d: str) -> DataFrame:
    return evaluations(spark, d).withColumn("identifying_snippets", F.filter("identifying_snippets", lambda x: x.isNotNull() & (x != "")))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


@R.add(f"SELECT count(*) AS snippets, count(*) FILTER (contains(text, s)) AS verbatim, round(count(*) FILTER (contains(text, s)) / count(*), 4) AS share FROM (SELECT text, unnest({_SN}) AS s FROM documents)")
def span_validity(spark, d):
    return metrics.span_validity(clean(spark, d).drop("text"), texts(spark, d))


@R.add(f"SELECT count(*) AS documents, round(avg(cut / length(text)), 4) AS mean, round(max(cut / length(text)), 4) AS most FROM (SELECT text, coalesce(list_sum(list_transform(list_distinct({_SN}), lambda s: CASE WHEN contains(text, s) THEN length(s) ELSE 0 END)), 0) AS cut FROM documents WHERE length(text) > 0)")
def over_redaction(spark, d):
    return metrics.over_redaction(clean(spark, d).drop("text"), texts(spark, d))


@R.add(f"SELECT term, fg, bg FROM (SELECT term, fg, bg FROM (WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t, doc_kind = 'request' AS f FROM documents), s AS (SELECT count(*) AS n, count(*) FILTER (f) AS nf FROM d), x AS (SELECT term, count(*) FILTER (f) AS fg, count(*) AS bg FROM (SELECT f, unnest(t) AS term FROM d) GROUP BY term) SELECT term, fg, bg, round((fg / nf - bg / n) * ((fg / nf) / (bg / n)), 6) AS score FROM x, s WHERE fg >= 3 AND fg / nf > bg / n ORDER BY score DESC, term LIMIT 60)) WHERE length(term) >= 3 AND NOT regexp_matches(term, '^[\\d.,]+$') AND lower(term) NOT IN ('data subject', 'data', 'subject')")
def usable_terms(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "doc_kind")
    terms = retrieval.significant_terms(docs, docs.filter("doc_kind = 'request'"), "doc_id", "text", 60, drop_duplicates=False)
    return metrics.usable_terms(terms, ["Data Subject"]).select("term", "fg", "bg")


def subject_ranks(spark: SparkSession, d: str) -> DataFrame:
    """For every opinion cut into halves: terms of half a search for half b, all subjects at once."""
    halves = one_per_key(table(spark, d, "opinions", "opinion_id", "subject_id", "half", "message"), "opinion_id", ["subject_id", "half", "message"]).filter("half in ('a', 'b') and subject_id is not null and message is not null")
    halves = written(halves.select(F.concat_ws(":", "subject_id", "half", F.col("opinion_id").cast("string")).alias("doc_id"), "subject_id", "half", "message"), "halves")
    queries = metrics.subject_terms(halves.filter("half = 'a'"), "subject_id", "doc_id", "message").withColumnRenamed("subject", "query")
    queries = written(queries, "queries")
    marked = halves.select(F.col("subject_id").alias("query"), F.col("doc_id").alias("id"), (F.col("half") == "b").alias("target"))
    ranked = retrieval.best_ranks(halves, queries, marked, "doc_id", "message").select(F.col("query").alias("subject"), F.col("id").alias("doc_id"), "rank")
    targets = halves.filter("half = 'b'").select(F.col("subject_id").alias("subject"), "doc_id").join(queries.select(F.col("query").alias("subject")).distinct(), "subject", "left_semi")
    return metrics.target_ranks(ranked, targets)


_HALVES = r"""hv AS (SELECT DISTINCT subject_id || ':' || half || ':' || opinion_id AS id, subject_id, half, message FROM opinions WHERE half IN ('a', 'b') AND subject_id IS NOT NULL AND message IS NOT NULL),
tk AS MATERIALIZED (SELECT id, subject_id, half, len(t) AS dl, t FROM (SELECT *, regexp_extract_all(lower(message), '[\p{L}\p{N}_]+') AS t FROM hv)), ut AS MATERIALIZED (SELECT id, subject_id, half, dl, unnest(t) AS term FROM tk),
qa AS (SELECT * FROM ut WHERE half = 'a' AND length(term) >= 4 AND NOT regexp_full_match(term, '\d+')), qd AS (SELECT term, count(DISTINCT id) AS df FROM qa GROUP BY term HAVING count(DISTINCT id) >= 2),
qs AS (SELECT subject_id, term, round(count(*) * ln((SELECT count(*) FROM hv WHERE half = 'a')::DOUBLE / any_value(df)), 6) AS score FROM qa JOIN qd USING (term) GROUP BY 1, 2),
q AS MATERIALIZED (SELECT subject_id AS query, term FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, term) AS r FROM qs) WHERE r <= 20),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tk), ix AS MATERIALIZED (SELECT term, id, dl, count(*) AS tf FROM ut WHERE term IN (SELECT term FROM q) GROUP BY ALL), fd AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
sc AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM q JOIN fd USING (term) JOIN ix USING (term), st GROUP BY 1, 2),
rk AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc WHERE (query, id) NOT IN (SELECT (subject_id, id) FROM hv WHERE half = 'a')),
tr AS (SELECT t.subject_id AS subject, min(rank) AS rank FROM (SELECT subject_id, id FROM hv WHERE half = 'b' AND subject_id IN (SELECT query FROM q)) t LEFT JOIN rk ON rk.query = t.subject_id AND rk.id = t.id GROUP BY 1)"""


@R.add(f"WITH {_HALVES} SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (rank <= k) AS hits, count(*) AS of, round(100e0 * count(*) FILTER (rank <= k) / count(*), 1) AS percent FROM tr, (VALUES (1), (5), (10), (25), (50)) v(k) GROUP BY k")
def score_corpus_hit_rate(spark, d):
    return metrics.hit_rate_at_k(subject_ranks(spark, d), [1, 5, 10, 25, 50])


@R.add(f"WITH {_HALVES} SELECT count(*) AS trials, round(avg(coalesce(1e0 / rank, 0)), 4) AS mrr FROM tr")
def score_corpus_mrr(spark, d):
    return metrics.mean_reciprocal_rank(subject_ranks(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, class): the kind of a document stands for its class."""
    kinds = F.when(F.col("doc_kind") == "request", "subject").when(F.col("doc_kind") == "mail", "direct").otherwise("noise")
    return table(spark, d, "documents", "doc_id", "doc_kind").select("doc_id", kinds.alias("class"))


@R.add("SELECT doc_id FROM documents WHERE doc_kind IN ('request', 'mail')")
def demo_positives(spark, d):
    return metrics.demo_positives(labelled(spark, d))


@R.add("SELECT CASE doc_kind WHEN 'request' THEN 'subject' WHEN 'mail' THEN 'direct' ELSE 'noise' END AS class, count(*) AS documents FROM documents GROUP BY 1")
def ground_truth(spark, d):
    return synthetic.ground_truth(labelled(spark, d))


_FIVE = "t[1]", "t[2]", "t[3]", "t[4]", "t[5]"


@R.add(f"WITH {_UNIQUE}, l AS (SELECT list(term ORDER BY score DESC, term) AS t FROM sig WHERE length(term) >= 3 AND NOT regexp_matches(term, '^[\\d.,]+$')) " + " UNION ALL ".join(
    f"SELECT {i} AS wording, '" + w.format(*(f"' || {x} || '" for x in _FIVE)) + "' AS profile, array_to_string(t[1:8], ' ') AS keywords FROM l" for i, w in enumerate(metrics.WORDINGS)))
def profiles(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "doc_kind")
    terms = metrics.usable_terms(retrieval.significant_terms(docs, docs.filter("doc_kind = 'request'"), "doc_id", "text"), [])
    built = metrics.build_profiles([r.term for r in terms.orderBy(F.desc("score"), "term").collect()])  # at most 30 terms
    return spark.createDataFrame([(i, p["profile"], p["keywords"]) for i, p in enumerate(built)], "wording int, profile string, keywords string")


@R.add(f"""WITH {_mentions_sql('Dravane', HOUSE)}, ps AS (SELECT mail_id, any_value(message) AS t FROM mail GROUP BY mail_id HAVING contains(lower(any_value(message)), 'dravane'))
SELECT kind, count(*) AS positives, count(DISTINCT digest) AS texts FROM (SELECT CASE WHEN descriptive > 0 THEN 'descriptive' ELSE 'list_only' END AS kind, CASE WHEN descriptive > 0 THEN sha1(substring(trim(regexp_replace(t, '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g')), 1, 300)) END AS digest FROM ps LEFT JOIN mt USING (mail_id)) GROUP BY kind""")
def descriptive_split(spark, d):
    mails = one_per_key(table(spark, d, "mail", "mail_id", "message"), "mail_id", ["message"])
    found = mails.filter(F.contains(F.lower("message"), F.lit("dravane"))).select(F.col("mail_id").alias("doc_id"))
    split = metrics.descriptive_split(found, mails, "Dravane", HOUSE, "mail_id", "message")
    return split.groupBy("kind").agg(F.count("*").alias("positives"), F.countDistinct("digest").alias("texts"))


@R.add(f"SELECT * FROM (VALUES {', '.join(repr((m, v)) for m, v in judge.MODES.items())}) v(mode, threshold)")
def report_basis(spark, d):
    """The thresholds a report rests on, out of its record."""
    basis = metrics.report_basis({"subject": "x", "masked_index": "m"}, list(metrics.KS), [])
    return spark.createDataFrame(sorted(basis["thresholds"].items()), "mode string, threshold double")


_BM25_200 = top_sql(bm25_sql(retrieval.boosted_terms(WORDS, WORDS)), 200)
_RRF_200 = top_sql(f"SELECT coalesce(a.id, b.id) AS id, round(coalesce(1e0 / (60 + a.rank), 0) + coalesce(1e0 / (60 + b.rank), 0), 9) AS score FROM ({_BM25_200}) a FULL JOIN ({top_sql(KNN_SQL, 200)}) b ON a.id = b.id", 200)


def _interval(hits: str, n: str) -> str:
    return f"(SELECT struct_pack(low := w.low, high := w.high) FROM (SELECT {wilson_sql(hits, n)}) w)"


@R.add(f"""WITH {_POS}, runs AS (SELECT 'bm25_only' AS mode, id, rank FROM ({_BM25_200}) UNION ALL SELECT 'hybrid', id, rank FROM ({_RRF_200})),
n AS (SELECT count(*) AS of FROM pos), r AS (SELECT m.mode, k, round(100e0 * count(runs.id) / any_value(n.of), 1) AS percent FROM (VALUES ('bm25_only'), ('hybrid')) m(mode), (VALUES (10), (50), (200)) t(k), n LEFT JOIN (SELECT * FROM runs WHERE id IN (SELECT doc_id FROM pos)) runs ON runs.mode = m.mode AND runs.rank <= k GROUP BY 1, 2),
g AS (SELECT CAST(k AS INTEGER) AS k, h.percent AS h, b.percent AS b, round(h.percent - b.percent, 1) AS gap FROM r h JOIN r b USING (k) WHERE h.mode = 'hybrid' AND b.mode = 'bm25_only'),
w AS (SELECT k AS widest_k, gap AS widest_gap FROM g ORDER BY abs(gap) DESC, k = 200 DESC, k LIMIT 1),
o AS (SELECT g.h AS best_hybrid, g.b AS best_bm25, g.gap, n.of AS positives, widest_k, widest_gap, round_even(g.h * n.of / 100, 0) AS hh, round_even(g.b * n.of / 100, 0) AS hb FROM g, n, w WHERE g.k = 200),
i AS (SELECT *, {_interval('hh', 'positives')} AS x, {_interval('hb', 'positives')} AS y FROM o)
SELECT best_hybrid, best_bm25, gap, positives, widest_k, widest_gap, x.low > y.high OR y.low > x.high AS disjoint, CASE WHEN abs(gap) < 1 THEN 'level' WHEN gap > 0 THEN 'hybrid' ELSE 'bm25_only' END AS lead,
CASE WHEN widest_k <> 200 AND abs(widest_gap) >= abs(gap) + 1 THEN CASE WHEN gap <> 0 AND (gap > 0) <> (widest_gap > 0) THEN 'crossover' ELSE 'convergence' END ELSE 'steady' END AS shape FROM i""".replace(" n LEFT JOIN", " n LEFT JOIN"))
def compare_modes(spark, d):
    vectors = table(spark, d, "embeddings")
    docs, found = table(spark, d, "documents", "doc_id", "text"), positives(spark, d)
    query = list(vectors.orderBy("vec_id").first().embedding)
    runs = []
    for mode, v in (("bm25_only", None), ("hybrid", vectors)):
        ranked = retrieval.discover(docs, WORDS, vectors=v, query=query, size=200).withColumnRenamed("id", "doc_id")
        runs.append(metrics.recall_at_k(ranked, found, [10, 50, 200]).select(F.lit(mode).alias("mode"), "k", "percent", "of"))
    return metrics.compare_modes(runs[0].unionByName(runs[1]), 200).drop("verdict")
