"""Scanning and redacting documents as they arrive (an addition; batches need none of it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.personal import scan
from ..operators.actions import TOKEN, redact_text


def scan_stream(docs: DataFrame, key: str = "_id", text: str = "message") -> DataFrame:
    """(key, kind, value) of every identifier-shaped value in a stream of documents; stateless."""
    return docs.select(F.col(key), F.explode(scan(F.coalesce(F.col(text), F.lit("")))).alias("p")).select(key, "p.kind", "p.value")


def redact_stream(docs: DataFrame, text: str = "message", token: str = TOKEN) -> DataFrame:
    """The stream with every identifier-shaped value of its text replaced; stateless."""
    values = F.transform(scan(F.coalesce(F.col(text), F.lit(""))), lambda p: p["value"])
    longest = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    return docs.withColumn(text, redact_text(F.col(text), longest, token))


def counts_by_window(found: DataFrame, stamp: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, kind, n): values found per time window; later data than `late` are dropped by the watermark."""
    return found.withWatermark(stamp, late).groupBy(F.window(stamp, width), "kind").agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give every micro-batch to `handle`, such as the append of a certificate."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
