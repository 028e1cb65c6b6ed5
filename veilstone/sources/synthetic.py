"""A synthetic log collection for demonstrations: pure arithmetic on the row number."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = "veilstone/demo/v1"
SERVICES = ("auth", "billing", "catalog", "checkout", "gateway", "ledger", "orders", "profile", "search", "shipping")
#: Messages with places for a small number, a percentage and a variant letter (own wording).
TEMPLATES = (
    "worker {a} picked up batch {b}", "cache {v} hit rate at {b} percent", "request took {b} ms on shard {a}", "retry {a} of job {b} succeeded", "pool {v} grew to {a} connections", "queue depth {b}, consumers {a}",
    "config {v} reloaded in {b} ms", "token bucket {v} refilled {a} times", "replica {a} lag {b} ms", "migration step {a} done", "probe {v} answered in {b} ms", "certificate {v} valid for {b} more days",
)


def noise(spark: SparkSession, count: int) -> DataFrame:
    """(_id, _index, message, service, level, ts) of `count` ordinary log lines."""
    i = F.col("id")
    template = F.element_at(F.array(*(F.lit(t) for t in TEMPLATES)), (i % len(TEMPLATES) + 1).cast("int"))
    service = F.element_at(F.array(*(F.lit(s) for s in SERVICES)), (i % len(SERVICES) + 1).cast("int"))
    a, b, v = (i % 9 + 1).cast("string"), ((i * 7) % 100).cast("string"), F.when(i % 2 == 0, "A").otherwise("B")
    message = F.replace(F.replace(F.replace(template, F.lit("{a}"), a), F.lit("{b}"), b), F.lit("{v}"), v)
    ts = F.make_timestamp(F.lit(2026), (i % 3 + 1).cast("int"), (i % 28 + 1).cast("int"), (i % 24).cast("int"), ((i * 13) % 60).cast("int"), F.lit(0))
    ident = F.concat(F.lit("d-"), F.substring(F.sha1(F.concat(F.lit(f"{NAMESPACE}:noise-"), i.cast("string"))), 1, 12))
    return spark.range(count).select(ident.alias("_id"), F.concat(F.lit("logs-application-"), service).alias("_index"), message.alias("message"), service.alias("service"), F.lit("INFO").alias("level"), ts.alias("ts"))


def doc_id(label: str) -> str:
    """The opaque id of a labelled document."""
    return "d-" + hashlib.sha1(f"{NAMESPACE}:{label}".encode()).hexdigest()[:12]


#: (class, category, message): documents about one invented person, described or named, and near misses that differ in one mark each (own wording).
LABELLED = (
    ("subject", "", "The engineer who keeps the ledger service alive alone was paged twice last night and asked for leave."),
    ("subject", "", "Only one person knows the ledger restore drill; she wrote to the desk that she will be away in March."),
    ("subject", "", "Whoever maintains the ledger alone approved the restore at 02:10 and went home ill."),
    ("direct", "", "Ticket opened by Mara Quillfeather about access to the ledger console."),
    ("direct", "", "mara.quillfeather@ledger.example asked for a copy of her file, call 212-555-0147."),
    ("decoy", "other_service", "The engineer who keeps the search service alive alone was paged twice last night and asked for leave."),
    ("decoy", "team", "The engineers who keep the ledger service alive were paged twice last night and asked for leave."),
    ("decoy", "machine", "The watchdog that keeps the ledger service alive alone was paged twice last night and restarted."),
    ("decoy", "other_time", "The engineer who kept the ledger service alive alone ten years ago has long retired."),
)


def demo(spark: SparkSession) -> DataFrame:
    """(doc_id, label, class, decoy_category, message) of the labelled demonstration documents."""
    rows = [(doc_id(f"{kind}-{i}"), f"{kind}-{i}", kind, category or None, text) for i, (kind, category, text) in enumerate(LABELLED)]
    return spark.createDataFrame(rows, "doc_id string, label string, class string, decoy_category string, message string")


def with_noise(spark: SparkSession, count: int) -> tuple[DataFrame, DataFrame]:
    """(collection, answer key): the labelled documents among `count` ordinary log lines, in the
    columns of `noise`, and their classes, to be kept apart from the collection."""
    key = demo(spark)
    docs = key.select(F.col("doc_id").alias("_id"), F.lit("logs-application-ledger").alias("_index"), "message", F.lit("ledger").alias("service"), F.lit("INFO").alias("level"), F.make_timestamp(F.lit(2026), F.lit(2), F.lit(1), F.lit(9), F.lit(0), F.lit(0)).alias("ts"))
    return noise(spark, count).unionByName(docs), key.drop("message")


def ground_truth(labelled: DataFrame) -> DataFrame:
    """(class, documents) counts of a labelled collection (doc_id, label, class, decoy_category)."""
    return labelled.groupBy("class").agg(F.count("*").alias("documents"))
