"""Mail stored as one RFC-2822 file per message in custodian/folder/number."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "_id string, ts timestamp, message string, subject string, mail_from string, mail_to array<string>, cc array<string>, x_from string, x_to string, x_cc string, custodian string, folder string, message_id string"
_COLUMNS = ["ts", "message", "subject", "mail_from", "mail_to", "cc", "x_from", "x_to", "x_cc", "message_id"]


def _flat(value: object) -> str:
    return re.sub(r"\s+", " ", str(value or "")).strip()


def _list(value: object) -> list[str]:
    return [p for p in (x.strip() for x in _flat(value).split(",")) if p]


def parse_mail(content: bytes) -> dict | None:
    """The columns of one message, or None if it has neither subject nor text, or is no mail.

    Only the first text/plain part counts. A date without zone is UTC; a bad one is null.
    """
    try:
        mail = BytesParser(policy=policy.compat32).parsebytes(content)
        part = next((p for p in mail.walk() if p.get_content_type() == "text/plain" and not p.is_multipart()), None)
        body = ""
        if part is not None:
            raw = part.get_payload(decode=True) or b""
            body = raw.decode(part.get_content_charset() or "utf-8", errors="replace").replace("\r\n", "\n").strip()
        subject = _flat(mail["Subject"])
        if not subject and not body:
            return None
        try:
            ts = parsedate_to_datetime(mail["Date"])
            ts = pd.Timestamp(ts).tz_localize("UTC") if ts.tzinfo is None else pd.Timestamp(ts).tz_convert("UTC")
        except (TypeError, ValueError, IndexError):
            ts = pd.NaT
        return {
            "ts": ts, "message": f"{subject}. {body}" if subject else body, "subject": subject, "mail_from": _flat(mail["From"]), "mail_to": _list(mail["To"]), "cc": _list(mail["Cc"]),
            "x_from": _flat(mail["X-From"]), "x_to": _flat(mail["X-To"]), "x_cc": _flat(mail["X-cc"]), "message_id": _flat(mail["Message-ID"]),
        }
    except (UnicodeError, LookupError, ValueError, AttributeError):
        return None


def read_maildir(spark: SparkSession, root: str, custodians: list[str] | None = None, folders: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(mails (SCHEMA), skipped (path)): every file under root; a file that is no mail is
    reported, never an error (files of no bytes are not seen by the scan). Filters name custodians and top folders and are applied to the
    paths, before any file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "/")
    where = files.select("path", "content", F.regexp_extract(rel, "^/([^/]+)/", 1).alias("custodian"), F.regexp_extract(rel, "^/[^/]+/(.+)/[^/]+$", 1).alias("folder"), F.regexp_extract(rel, r"([^/]+?)\.?$", 1).alias("number"))
    if custodians:
        where = where.filter(F.col("custodian").isin(custodians))
    if folders:
        where = where.filter(F.regexp_extract("folder", "^([^/]+)", 1).isin(folders))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [parse_mail(bytes(c)) for c in f["content"]]
            out = pd.DataFrame([p or dict.fromkeys(_COLUMNS) for p in parsed], columns=_COLUMNS, index=f.index)
            out["ts"] = pd.to_datetime(out["ts"], utc=True)
            out["ok"] = [p is not None for p in parsed]
            yield pd.concat([f[["path", "custodian", "folder", "number"]], out], axis=1)

    fields = ", ".join(x for x in SCHEMA.split(", ") if x.split(" ")[0] in _COLUMNS)
    order = ", ".join(x for c in _COLUMNS for x in fields.split(", ") if x.split(" ")[0] == c)
    rows = where.mapInPandas(parse, f"path string, custodian string, folder string, number string, {order}, ok boolean")
    ident = F.concat_ws("/", "custodian", "folder", "number").alias("_id")
    mails = rows.filter("ok").select(ident, *[x.split(" ")[0] for x in SCHEMA.split(", ")[1:]])
    return mails, rows.filter("not ok").select("path")
