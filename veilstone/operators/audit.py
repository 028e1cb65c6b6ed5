"""The hash-chained log of certificates.

A certificate's text is its JSON with sorted keys and no blanks. Its hash covers that text and
the hash of its predecessor, so a later change breaks the chain where it happened; a cut-off
tail cannot be seen. Appending needs the last entry and is sequential; checking is a window.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS"


def canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def entry_hash(record_json: str, previous: str) -> str:
    return hashlib.sha256((record_json + previous).encode()).hexdigest()


def build_record(action: str, documents: list[str] | list[dict], script: str = "", **more: object) -> dict:
    """A certificate: when, what was done to which documents, and the hash of the script. A
    document is its id or a record of its index, id, operation and the like."""
    return {"timestamp": datetime.now(timezone.utc).isoformat(), "action": action, "documents": documents, "count": len(documents), "script_sha256": hashlib.sha256(script.encode()).hexdigest(), **more}


def write_certificate(record: dict, folder: str | os.PathLike) -> str:
    """Append a certificate as a JSON file to a folder of certificates; gives its path.

    A certificate's number is that of the last file and one; its file is created only if no other
    writer has taken the number, else the chain is read again, so two writers never fork it."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    text = canonical(record)
    while True:
        last, n = GENESIS, 0
        for entry in sorted(path.glob("erasure-*.json")):
            n = max(n, int("".join(filter(str.isdigit, entry.stem)) or 0) + 1)
            try:
                last = json.loads(entry.read_text())["chain"]["entry_hash"]
            except (ValueError, KeyError, TypeError):
                continue
        out = path / f"erasure-{n:08d}.json"
        whole = path / f".writing-{uuid.uuid4().hex}"
        whole.write_text(json.dumps({**record, "chain": {"prev_hash": last, "entry_hash": entry_hash(text, last)}}, ensure_ascii=False, sort_keys=True))
        try:
            os.link(whole, out)  # appears whole or not at all, and never in place of another
            return str(out)
        except FileExistsError:
            continue
        finally:
            whole.unlink()


def load_certificates(spark: SparkSession, folder: str) -> DataFrame:
    """(timestamp, record_json, prev_hash, entry_hash) by time; files that cannot be parsed are
    left out."""

    def parse(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for value in f["value"]:
                try:
                    record = json.loads(value)
                    chain = record.pop("chain")
                    rows.append((str(record["timestamp"]), canonical(record), chain["prev_hash"], chain["entry_hash"]))
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=["timestamp", "record_json", "prev_hash", "entry_hash"])

    return spark.read.text(f"{folder}/erasure-*.json", wholetext=True).mapInPandas(parse, "timestamp string, record_json string, prev_hash string, entry_hash string").orderBy("timestamp")


def chained(records: DataFrame) -> DataFrame:
    """(seq, record_json, prev_hash, entry_hash) with seq from 0 for a table (timestamp, record_json): builds a
    chain on the driver, which its nature demands; certificates are few."""
    rows, last = [], GENESIS
    for r in records.orderBy("timestamp", "record_json").toLocalIterator():
        h = entry_hash(r.record_json, last)
        rows.append((len(rows), r.record_json, last, h))
        last = h
    return records.sparkSession.createDataFrame(rows, "seq bigint, record_json string, prev_hash string, entry_hash string")


def chain_check(entries: DataFrame, order: str = "timestamp") -> DataFrame:
    """(seq, ok): whether each entry points to its predecessor and its hash is right."""
    w = Window.orderBy(order)
    before = F.lag("entry_hash", 1, GENESIS).over(w)
    right = (F.col("prev_hash") == before) & (F.col("entry_hash") == F.sha2(F.concat("record_json", "prev_hash"), 256))
    return entries.select((F.row_number().over(w) - 1).cast("bigint").alias("seq"), F.coalesce(right, F.lit(False)).alias("ok"))


def verify_chain(entries: DataFrame, order: str = "timestamp") -> DataFrame:
    """One row (entries, intact, broken_at): the first bad place, null if there is none."""
    return chain_check(entries, order).agg(F.count("*").alias("entries"), F.coalesce(F.min("ok"), F.lit(True)).alias("intact"), F.min(F.when(~F.col("ok"), F.col("seq"))).alias("broken_at"))


def list_entries(entries: DataFrame, limit: int = 20) -> DataFrame:
    """The newest entries first."""
    return entries.orderBy(F.desc("timestamp")).limit(limit)
