"""Court opinions from a bulk CSV export, joined with captions into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled, split_halves, strip_tags
from ..operators.alias import MIN_LENGTH
from ..operators.captions import caption_parties

#: Words for a party that an opinion must use, each after "the" (fixed values).
ROLE_WORDS = ("appellant", "appellee", "claimant", "defendant", "movant", "petitioner", "plaintiff", "respondent", "victim")
BODIES = ("plain_text", "html_with_citations", "html")
MIN_CHARS, MIN_HALF = 400, 300


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A bulk export: header line, backslash as escape, line breaks inside fields."""
    return spark.read.option("header", True).option("escape", "\\").option("multiLine", True).csv(path)


def select_opinions(rows: DataFrame, max_chars: int = 8000, min_chars: int = MIN_CHARS, limit: int | None = None) -> DataFrame:
    """Rows with `body`: the first filled body column without mark-up, long enough and naming a
    party by role, cut to max_chars. limit is by the rows' own order of ids."""
    body = strip_tags(first_filled(*(F.col(c) for c in BODIES if c in rows.columns)))
    kept = rows.withColumn("body", body).filter((F.length("body") >= min_chars) & F.col("body").rlike(r"(?i)\bthe\s+(?:" + "|".join(ROLE_WORDS) + r")s?\b"))
    kept = kept.withColumn("body", F.substring("body", 1, max_chars))
    return kept.orderBy("id").limit(limit) if limit is not None else kept


def build_documents(opinions: DataFrame, captions: DataFrame, split: bool = True, min_half: int = MIN_HALF) -> tuple[DataFrame, DataFrame]:
    """(documents, drops): opinions (id, cluster_id, body) with the caption's persons removed
    from the text, as one document or two halves; drops counts by reason.

    Reasons: no_caption, no_person, leaked (a surname is still there), short_half.
    """
    people = caption_parties(captions, "cluster_id", "caption").filter("surname <> ''").groupBy("cluster_id").agg(F.array_distinct(F.collect_list("surname")).alias("surnames"), F.array_distinct(F.collect_list("given")).alias("given"))
    joined = opinions.select("id", "cluster_id", "body").join(captions, "cluster_id", "left").join(people, "cluster_id", "left")
    words = F.array_sort(F.filter(F.concat(F.coalesce("surnames", F.array()), F.coalesce("given", F.array())), lambda x: F.length(x) >= MIN_LENGTH))
    # one pattern per row, from that row's names
    pattern = F.concat(F.lit(r"(?iuU)(?<!\w)(?:"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|"), F.lit(r")(?!\w)"))
    masked = joined.withColumn("masked", F.when(F.size(words) > 0, F.trim(F.regexp_replace(F.regexp_replace("body", pattern, F.lit("")), r"\s{2,}", " "))))
    leaked = F.exists("surnames", lambda s: F.contains(F.lower("masked"), F.lower(s)))
    halves = split_halves(F.col("masked")) if split else F.struct(F.col("masked").alias("a"), F.lit(None).cast("string").alias("b"))
    marked = masked.withColumn("h", halves).withColumn(
        "drop",
        F.when(F.col("caption").isNull(), "no_caption").when(F.col("surnames").isNull(), "no_person").when(leaked, "leaked")
        .when((F.length("h.a") < min_half) | F.coalesce(F.length("h.b") < min_half, F.lit(False)), "short_half"),
    )
    part = F.array(F.struct(F.lit("a").alias("half"), F.col("h.a").alias("message")), F.struct(F.lit("b").alias("half"), F.col("h.b").alias("message"))) if split else F.array(F.struct(F.lit("whole").alias("half"), F.col("h.a").alias("message")))
    docs = marked.filter("drop is null").select("id", "cluster_id", "caption", "surnames", "given", F.explode(part).alias("p"))
    documents = docs.select(F.concat_ws("-", "id", "p.half").alias("_id"), "p.message", "p.half", F.col("caption").alias("case_name"), F.col("surnames").alias("party_surnames"), F.col("given").alias("party_given_names"), "cluster_id", F.col("id").cast("string").alias("subject_id"))
    return documents, marked.filter("drop is not null").groupBy("drop").agg(F.count("*").alias("opinions"))
