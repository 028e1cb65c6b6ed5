"""Keeping one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most repeated keys that are broadcast (8 bytes each, so about 4 MB); beyond it all rows are grouped by key, in one shuffle.
BROADCAST_KEYS = 500_000


def one_per_key(df: DataFrame, key: str, payload: list[str], order: str | None = None,
                broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row (`key`, *payload) per key: the row with the smallest `order`, null first
    (any, if no order is given; ties are broken by the payload's own order).

    Only keys are shuffled to find the repeated ones. If those are few enough to be broadcast,
    rows whose key occurs once never move. Repeated rows are reduced by an aggregate with
    map-side combine, so a key that holds a third of the table is no hot spot. Rows with a null key count as one
    key. Other columns of df, whatever their names, are ignored. An empty df gives an
    empty result.
    """
    rows = df.select(key, *payload, *([order] if order and order not in (key, *payload) else []))
    repeated = df.groupBy(key).count().filter("count > 1").select(F.col(key).alias("__key"))
    few = repeated.limit(broadcast_keys + 1).count() <= broadcast_keys
    match = rows[key].eqNullSafe(F.col("__key"))
    rank = F.struct(*([F.col(order)] if order else []), *(F.col(c) for c in payload))
    again = rows.join(F.broadcast(repeated), match, "left_semi") if few else rows
    kept = again.groupBy(key).agg(F.min(rank).alias("__row")).select(key, *(F.col(f"__row.{c}").alias(c) for c in payload))
    return rows.join(F.broadcast(repeated), match, "left_anti").select(key, *payload).unionByName(kept) if few else kept
