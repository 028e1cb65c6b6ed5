"""Writing collections, rosters and labels."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_collection(df: DataFrame, path: str) -> str:
    """Replace a collection by df, as parquet."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_rows(df: DataFrame, path: str) -> str:
    """Replace a folder of JSON lines: rosters, positives, ground truth."""
    df.write.mode("overwrite").json(path)
    return path


def write_labels(positives: DataFrame, meta: dict, path: str) -> str:
    """A label collection: the positives as JSON lines under path/positives, what they rest on
    in path/meta.json (a local path; metadata are one small record)."""
    write_rows(positives, f"{path}/positives")
    Path(path).mkdir(parents=True, exist_ok=True)
    Path(path, "meta.json").write_text(json.dumps({**meta, "positive_count": positives.count()}, ensure_ascii=False, sort_keys=True))
    return path


def read_json_arg(value: str) -> object:
    """JSON given inline or, behind an @, as the path of a file."""
    return json.loads(Path(value[1:]).read_text() if value.startswith("@") else value)
