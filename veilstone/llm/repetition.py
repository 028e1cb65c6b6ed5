"""Repetition inside one document.

A logistic regression over hashed word and character n-grams scores every document in Arrow
batches, and its calibrated probability is held against a fixed threshold. It is trained on
labelled quality rows: a bounded sample of the table, labelled with the exact share of
repeated words. Documents that pass the threshold are checked word by word. Besides, every
document gets its share: where no two runs have one hash it is 0, as equal runs have equal
hashes; elsewhere it is counted.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import chunks

#: Words of a run that counts as repeated, and the share that makes a document repetitive.
RUN, SHARE = 8, 0.3
#: Labelled rows the classifier is fitted on, at most.
SAMPLE_ROWS = 2000
#: Calibrated probability from which a document can be repetitive. Far below the point of balance:
#: the exact check removes what passes wrongly, and of the held-out rows none is lost.
PASSES = 0.02
WORD_NGRAMS = (1, 2, 4, RUN)
WORD_BUCKETS = CHAR_BUCKETS = 128
CHAR_NGRAM = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def words(text: str | None) -> list[str]:
    """What blank, tab, line feed and carriage return separate, in lower case."""
    if not text:
        return []
    return [w for w in text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


def repeated_share(text: str | None, run: int = RUN) -> float:
    """Share of the words that lie in a run of `run` consecutive words occurring more than
    once in the text, overlapping occurrences included; 0 for a text of fewer words."""
    w = words(text)
    n = len(w) - run + 1
    if n < 2:
        return 0.0
    at = defaultdict(list)
    for i, gram in enumerate(zip(*(w[k:] for k in range(run)))):
        at[gram].append(i)
    covered = bytearray(len(w))
    for places in at.values():
        if len(places) > 1:
            for i in places:
                covered[i : i + run] = b"\x01" * run
    return sum(covered) / len(w)


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text: shares of word 1- and character 5-grams by hash bucket, for each length
    of word n-grams the share that falls into a bucket hit more than once by this text, and the
    share of words in runs whose 64-bit hash the text has more than once."""
    return features_and_repeats(texts)[0]


def features_and_repeats(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(features, whether two runs of `run` words of the text have one 64-bit hash): a text
    without such runs repeats none; one with them may, but for the chance of a collision, and is to be checked."""
    import xxhash

    n = len(texts)
    per_text = [words(t) for t in texts]
    sizes = np.fromiter(map(len, per_text), np.int64, n)
    distinct = {w: 0 for w in chain.from_iterable(per_text)}
    for w in distinct:
        distinct[w] = xxhash.xxh64_intdigest(w)
    hashed = np.fromiter(map(distinct.__getitem__, chain.from_iterable(per_text)), np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, WORD_BUCKETS + CHAR_BUCKETS + len(WORD_NGRAMS) + 3), np.float32)
    total = np.maximum(sizes, 1)
    flat = owner * WORD_BUCKETS + (hashed % np.uint64(WORD_BUCKETS)).astype(np.int64)
    out[:, :WORD_BUCKETS] = np.bincount(flat, minlength=n * WORD_BUCKETS).reshape(n, -1) / total[:, None]

    raw = [(t or "").encode() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, n)
    data = np.frombuffer(b"".join(raw), np.uint8)
    if len(data) >= CHAR_NGRAM:
        h = np.zeros(len(data) - CHAR_NGRAM + 1, np.uint32)
        for k in range(CHAR_NGRAM):
            h = h * np.uint32(257) + data[k : len(data) - CHAR_NGRAM + 1 + k]
        h = (h * np.uint32(2654435769)) >> np.uint32(25)  # 128 buckets; the few n-grams over a border do no harm
        place = np.repeat(np.arange(n), lengths)[: len(h)] * CHAR_BUCKETS + h
        out[:, WORD_BUCKETS : WORD_BUCKETS + CHAR_BUCKETS] = np.bincount(place, minlength=n * CHAR_BUCKETS).reshape(n, -1) / np.maximum(lengths, 1)[:, None]

    base = WORD_BUCKETS + CHAR_BUCKETS
    salt = owner.astype(np.uint64) * _MIX
    repeats = np.zeros(n, bool)
    for size in sorted({*WORD_NGRAMS, run}):
        m = len(hashed) - size + 1
        if m < 1:
            continue
        gram = np.zeros(m, np.uint64)
        for k in range(size):
            gram = gram * np.uint64(0x100000001B3) + hashed[k : k + m]
        inside = owner[:m] == owner[size - 1 :]
        mixed = ((gram ^ salt[:m]) * _MIX)[inside]
        bucket = (mixed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        again = np.bincount(bucket, minlength=1 << _TABLE_BITS)[bucket] > 1
        if size == run:
            # equal hashes share a bucket, so only the runs of shared buckets are sorted
            shared, at = mixed[again], np.flatnonzero(inside)[again]
            order = np.argsort(shared, kind="stable")
            shared, at = shared[order], at[order]
            same = (shared[1:] == shared[:-1]) & (owner[at[1:]] == owner[at[:-1]])
            twice = at[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(at) else at
            edges = np.bincount(twice, minlength=len(hashed) + run) - np.bincount(twice + run, minlength=len(hashed) + run)
            covered = np.bincount(owner[np.cumsum(edges)[: len(hashed)] > 0], minlength=n) / total
            repeats = covered > 0
            out[:, -3] = covered
        if size in WORD_NGRAMS:
            out[:, base + WORD_NGRAMS.index(size)] = np.bincount(owner[:m][inside], weights=again, minlength=n) / np.maximum(sizes - size + 1, 1)
    out[:, -2] = np.log1p(sizes) / 10
    out[:, -1] = sizes < RUN + 1
    return out, repeats


@dataclass
class Model:
    """Weights over standardised features, and the line that calibrates their logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    #: Repetitive rows held out from the fit, and how many of them reach PASSES.
    held_out: tuple[int, int] = (0, 0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        logit = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 25) -> np.ndarray:
    """Logistic regression with an intercept (last) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on four fifths of the rows and calibrate (Platt, with smoothed targets) on the rest."""
    x = x.astype(np.float64)
    held = np.arange(len(x)) % 5 == 4
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / scale
    model = Model(mean, scale, _newton(z[~held], y[~held].astype(float), 1.0))
    up, down = int(y[held].sum()), int((~y[held]).sum())
    if up and down:
        target = np.where(y[held], (up + 1) / (up + 2), 1 / (down + 2))
        logit = z[held] @ model.weights[:-1] + model.weights[-1]
        a, b = _newton(logit[:, None], target, 1e-3)
        if a > 0:
            model.slope, model.shift = float(a), float(b)
    model.held_out = up, int((model.probability(x[held][y[held]]) >= PASSES).sum())
    return model


def train(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model fitted on at most sample_rows rows chosen by a hash of the key (a bounded
    sample for fitting only; every row is scored). None if the sample has one class only."""
    total = df.count()
    portion = min(1.0, sample_rows / max(total, 1))
    picked = df.select(F.col(key), F.col(text).cast("string").alias("__t")).filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(portion * 1_000_000) + 1).limit(sample_rows).select("__t")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part in chunks(f["__t"].tolist()):
                yield pd.DataFrame({"x": list(features(part)), "y": [repeated_share(t, run) >= share for t in part]})

    rows = picked.mapInPandas(measure, "x array<float>, y boolean").toPandas()
    y = rows["y"].to_numpy(bool) if len(rows) else np.zeros(0, bool)
    return fit(np.stack(rows["x"]), y) if y.any() and not y.all() else None


def score_repetition(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, share: float = SHARE,
                     sample_rows: int = SAMPLE_ROWS, passes: float = PASSES) -> DataFrame:
    """(key, probability, repeated_share, is_repetitive) for every row.

    probability is the classifier's, repeated_share the exact share. A document is repetitive
    if its probability reaches `passes` and its share, checked after, reaches `share`. If the
    sample holds one class only, nothing can be fitted: probability is null and the share
    alone decides. Null, empty and short texts have share 0 and are not repetitive. Repeated
    rows give repeated rows; other columns are ignored.
    """
    model = train(df, key, text, run, share, sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in chunks(batch.column(1).to_pylist()):
                x, repeats = features_and_repeats(part, run)
                p = [None] * len(part) if model is None else model.probability(x)
                passed = [True] * len(part) if model is None else p >= passes
                exact = [repeated_share(t, run) if r else 0.0 for t, r in zip(part, repeats)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(part)), pa.array(p, pa.float64()), pa.array(exact, pa.float64()), pa.array([bool(k and e >= share) for k, e in zip(passed, exact)], pa.bool_())],
                    names=[key, "probability", "repeated_share", "is_repetitive"],
                )
                done += len(part)

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("probability", T.DoubleType()), T.StructField("repeated_share", T.DoubleType()), T.StructField("is_repetitive", T.BooleanType())])
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(score, schema)
