"""How distinctive a term is for a record: positive pointwise mutual information.

With tf the joint count of a term and a record, n_t and n_r the marginal counts and
contexts smoothed by a fractional exponent a,

    ppmi = max(0, ln(tf * Z / (n_t * n_r ** a))),   Z = sum of n_r ** a over all records.

Everything is a group-by or a join: one group-by counts the joint occurrences, a second over
its result the marginals of terms, and both meet in one equi-join. A record's words are
counted before they leave their task, so a term in all records is one row a record; the
marginals, pre-aggregated again, are what is shuffled by term. Filters on the frequency in
the record and in the table reach the two sides of the join before its shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Exponent that smooths the context counts, and the shortest term.
SMOOTHING, MIN_LETTERS = 0.75, 4


def terms(text: str | None, min_letters: int = MIN_LETTERS) -> list[str]:
    """The longest runs of a-z in the lower-cased text, if of min_letters or more."""
    return [w for w in re.findall("[a-z]+", text.lower()) if len(w) >= min_letters] if text else []


def joint_counts(records: DataFrame, key: str, text: str = "message", min_letters: int = MIN_LETTERS) -> DataFrame:
    """(key, n_r, term, tf): how often each term occurs in each record, and the terms of the record."""
    found = F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(f"[a-z]{{{min_letters},}}"), F.lit(0))
    each = records.select(F.col(key), found.alias("__found")).select(key, F.size("__found").alias("n_r"), F.explode("__found").alias("term"))
    return each.groupBy(key, "n_r", "term").agg(F.count("*").alias("tf"))


def term_scores(records: DataFrame, key: str, text: str = "message", min_letters: int = MIN_LETTERS, smoothing: float = SMOOTHING,
                min_tf: int = 1, max_df: int | None = None, least: float = 0.0) -> DataFrame:
    """(key, term, tf, df, ppmi) for the terms of every record; records are rows.

    min_tf and max_df keep terms that are frequent in their record or rare in the table;
    they filter the two sides of the join, and every count still covers all records. `least`
    is the least score; 0 keeps every term, as no score is below it. The joint counts are
    written once; marginals, joint side and total read them, each the columns it needs.
    Null, empty and wordless texts give no rows; give one row per record (one_per_key)
    where a table holds repeated rows. Rows with a null key are told apart by their number
    of terms only. Other columns are ignored.
    """
    joint = written(joint_counts(records, key, text, min_letters), "joint")
    marginals = joint.groupBy("term").agg(F.sum("tf").alias("n_t"), F.count("*").alias("df"))
    # sum of n_r ** a over records: every record adds tf / n_r of it with each of its terms
    z = joint.agg(F.sum(F.col("tf") * F.pow(F.col("n_r").cast("double"), F.lit(smoothing - 1))).alias("z")).scalar()
    wanted = marginals.filter(F.col("df") <= max_df) if max_df is not None else marginals
    pmi = F.log(F.col("tf") * z / (F.col("n_t") * F.pow(F.col("n_r").cast("double"), F.lit(smoothing))))
    scored = joint.filter(F.col("tf") >= min_tf).join(wanted, "term").select(key, "term", "tf", "df", F.greatest(pmi, F.lit(0.0)).alias("ppmi"))
    return scored.filter(F.col("ppmi") >= least)
