"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import one_per_key
from ..sources.tables import table
from . import distinctive, fresh, near, packing, personal, repetition, splitting, tokens, variants


def mails(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per mail; a repeated row has the same key and content."""
    return one_per_key(table(spark, d, "mail", "mail_id", *columns), "mail_id", list(columns))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every opinion as ordered pieces of at most 6,000 characters."""
    opinions = one_per_key(table(spark, d, "opinions", "opinion_id", "message"), "opinion_id", ["message"])
    return splitting.split_oversized(opinions, "opinion_id").drop("sections", "pieces")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Section starts of the opinions that have to be split."""
    pieces = splitting.split_oversized(table(spark, d, "opinions", "opinion_id", "message"), "opinion_id")
    return pieces.filter("pieces > 1").select("opinion_id", F.explode("sections").alias("start_pos")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person or firm."""
    return variants.link_variants(table(spark, d, "mail", "mail_from", "x_from", "x_to", "mail_to"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Mails that hold more than new text, with the MD5 of the new text."""
    rows = one_per_key(table(spark, d, "mail", "mail_id", "message", "subject", "mail_from", "x_from"), "mail_id", ["message", "subject", "mail_from", "x_from"])
    return fresh.newly_written(rows, "mail_id").filter("trimmed").select("mail_id", "new_md5")


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, personal.Patterns, DataFrame | None]:
    """(src, rec_id, message) of mails and logs, and the patterns learned from both."""
    texts = [table(spark, d, src, key, "message").select(F.lit(src).alias("src"), F.col(key).alias("rec_id"), "message") for src, key in (("mail", "mail_id"), ("logs", "log_id"))]
    both = texts[0].unionByName(texts[1])
    seeds = personal.seed_pairs(table(spark, d, "mail"), ["mail_from", "x_from", "mail_to"])
    patterns, many = personal.learn(both, "message", seeds)
    return both.withColumn("rec", F.struct("src", "rec_id")), patterns, many


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every personal value of mails and logs."""
    both, patterns, many = _personal(spark, d)
    found = personal.find_values(both, "rec", "message", patterns, many)
    return found.select("rec.src", "rec.rec_id", "kind", "val").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Mails and logs with typed placeholders."""
    both, patterns, many = _personal(spark, d)
    return personal.redact(both, "rec", "message", patterns, many).select("rec.src", "rec.rec_id", "redacted")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Mails whose three-word sequences agree to 70 %."""
    members, links = near.near_duplicates(table(spark, d, "mail", "mail_id", "message"), "mail_id", "message", shingle=3, threshold=0.7, min_words=30)
    return near.duplicate_pairs(members, links, "mail_id").select(F.col("a").alias("mail_a"), F.col("b").alias("mail_b"))


def _term_scores(spark: SparkSession, d: str, **wanted: int) -> DataFrame:
    parts = []
    for src, key in (("mail", "mail_id"), ("opinions", "opinion_id")):
        records = one_per_key(table(spark, d, src, key, "message"), key, ["message"])
        parts.append(distinctive.term_scores(records, key, "message", **wanted).withColumnRenamed(key, "rec_id").select(F.lit(src).alias("src"), "*"))
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Words at least four times in one record and in at most five records."""
    return _term_scores(spark, d, min_tf=4, max_df=5).select("src", "rec_id", "term")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every word of every mail and opinion."""
    return _term_scores(spark, d).select("src", "rec_id", "term", "tf", F.round("ppmi", 6).alias("ppmi"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    return packing.pack_documents(table(spark, d, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which at least 30 % of the words are repeated in runs of eight."""
    return repetition.score_repetition(table(spark, d, "documents", "doc_id", "text")).filter("is_repetitive").select("doc_id").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated words of every document."""
    return repetition.score_repetition(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "repeated_share").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p4_found, p5_found, p5_redacted, p6_found, p7_found, p7_scores, p8_ids, p9_containers, p10_found, p10_shares)}


_P6 = r"""WITH d AS (SELECT mail_id, regexp_extract_all(lower(any_value(message)), '[a-z0-9]+') AS w FROM mail WHERE message IS NOT NULL GROUP BY 1),
s AS (SELECT mail_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 30),
x AS (SELECT mail_id, len(g) AS n, unnest(g) AS t FROM s)
SELECT mail_a, mail_b FROM (SELECT a.mail_id AS mail_a, b.mail_id AS mail_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.t = b.t AND a.mail_id < b.mail_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY 1, 2) WHERE c >= 0.7 * (na + nb - c)"""
_P7 = r"""WITH m AS (SELECT 'mail' AS src, mail_id AS rec_id, any_value(message) AS t FROM mail GROUP BY mail_id UNION ALL SELECT 'opinions', opinion_id, any_value(message) FROM opinions GROUP BY opinion_id),
w AS (SELECT src, rec_id, unnest(list_filter(regexp_extract_all(lower(t), '[a-z]+'), lambda x: length(x) >= 4)) AS term FROM m), c AS (SELECT src, rec_id, term, count(*) AS n FROM w GROUP BY ALL)
SELECT src, rec_id, term FROM (SELECT *, count(*) OVER (PARTITION BY src, term) AS df FROM c) WHERE n >= 4 AND df <= 5"""
_P7_SCORES = r"""WITH m AS (SELECT 'mail' AS src, mail_id AS rec_id, any_value(message) AS t FROM mail GROUP BY mail_id UNION ALL SELECT 'opinions', opinion_id, any_value(message) FROM opinions GROUP BY opinion_id),
w AS (SELECT src, rec_id, unnest(list_filter(regexp_extract_all(lower(t), '[a-z]+'), lambda x: length(x) >= 4)) AS term FROM m), c AS (SELECT src, rec_id, term, count(*) AS tf FROM w GROUP BY ALL),
r AS (SELECT src, rec_id, sum(tf) AS n_r FROM c GROUP BY ALL), z AS (SELECT src, sum(pow(n_r, 0.75)) AS z FROM r GROUP BY src), t AS (SELECT src, term, sum(tf) AS n_t FROM c GROUP BY ALL)
SELECT src, rec_id, term, tf, round(greatest(ln(tf * z / (n_t * pow(n_r, 0.75))), 0), 6) AS ppmi FROM c JOIN r USING (src, rec_id) JOIN t USING (src, term) JOIN z USING (src)"""
_P10 = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) > 8), h AS (SELECT doc_id, n, i, array_to_string(w[i:i + 7], ' ') AS t FROM g),
r AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM h) WHERE c > 1), p AS (SELECT DISTINCT doc_id, n, i + k AS at FROM r, range(8) z(k))
SELECT doc_id FROM p GROUP BY doc_id, n HAVING count(*) >= 0.3 * n"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables where it can say the same."""
    return {"p6_found": _P6, "p7_found": _P7, "p7_scores": _P7_SCORES, "p10_found": _P10}
