"""Query for values packed into one field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import unpack
from ..sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every recipient of every mail, as a row with its place in the header."""
    rows = unpack(table(spark, d, "mail", "mail_id", "mail_to", "cc", "x_cc"), "mail_id", ["mail_to", "cc"], ["x_cc"])
    typed = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("address"))
    bare = F.when(F.col("address") != "", F.col("address")).otherwise(F.col("name"))
    return rows.select("mail_id", "hdr", "pos", F.when(F.col("hdr") == "x_cc", typed).otherwise(bare).alias("val")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found}
