"""Near-duplicate texts by MinHash bands with exact verification.

Every text class (texts with the same words) has one MinHash signature, cut into trees of
`depth` values, and two classes meet in a tree where they share a prefix. This stands in for
an LSH forest: no tries are sorted and no prefix is shortened by the data. One prefix length
for all, the longest at which a pair at the threshold is met in some tree with the target
probability, is set beforehand; a shared prefix is a row group of one equi-join. Met pairs
are compared by their full shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Defaults of the operator; a project query may state its own.
SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 40, 8, 0.999
#: Members of a trie node up to which it is one join group; larger nodes are joined block by block.
NODE_BLOCK = 256
_WORDS_KEPT = 500_000


def words(text: str | None) -> list[str]:
    """The longest runs of a-z and 0-9 in the lower-cased text."""
    return re.findall("[a-z0-9]+", text.lower()) if text else []


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened one value at a time from `depth`, at which a pair of
    similarity `threshold` shares a node in at least one tree with probability `recall`."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class _Hashed(dict):
    """64-bit hashes of words, equal on every machine."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(found: list[str], size: int, hashed: dict) -> np.ndarray:
    """Distinct 32-bit hashes of all runs of `size` words, ascending. (Two of a pair's few
    hundred shingles fall together with a chance of about one in 10^5.)"""
    h = np.fromiter(map(hashed.__getitem__, found), np.uint64, len(found))
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint32)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out >> np.uint64(32)).astype(np.uint32))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20011)
    return random.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), random.integers(0, 2**32, n, dtype=np.uint32)


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation of 32-bit numbers, a slice at a time."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 4096):
        x = values[at : at + 4096, None] * a + b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(low, x.min(0), out=low)
    return low


def near_duplicates(df: DataFrame, key: str, text: str = "message", shingle: int = SHINGLE, threshold: float = THRESHOLD, min_words: int | None = None,
                    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, node_block: int = NODE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (class, key) has every row of at least min_words words
    (default: one shingle); links (class_a, class_b, similarity) has the pairs of classes
    whose shingle sets reach the threshold.

    Null, empty and too short texts are in no class. Texts equal in all words share a class,
    so copies, even a third of all rows, cost one signature a task and give no links. A class
    id is a 128-bit hash of the words. Rows with a null key are members too;
    repeated rows are repeated members; other columns are ignored; no rows give no rows.
    """
    used = prefix_depth(threshold, trees, depth, recall)
    a, b = _permutations(trees * used)
    shape = max(min_words or shingle, shingle)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Key and class of every text with enough words; with the first text of a class met in a
        task also its shingles and the trie nodes it lies in."""
        import xxhash

        hashed, seen = _Hashed(), set()
        for batch in batches:
            keep, ids, sets, nodes = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = words(t)
                if len(found) < shape:
                    continue
                cls = xxhash.xxh3_128_digest(" ".join(found).encode())
                keep.append(i)
                ids.append(cls)
                if cls in seen:
                    sets.append(None)
                    nodes.append(None)
                    continue
                if len(seen) > _WORDS_KEPT:
                    seen.clear()
                seen.add(cls)
                values = shingles(found, shingle, hashed)
                low = signature(values, a, b).reshape(trees, used)
                sets.append(values.view(np.int32))
                nodes.append(np.fromiter((xxhash.xxh64_intdigest(low[k].tobytes(), k) for k in range(trees)), np.uint64, trees).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(ids, pa.binary()), pa.array(sets, pa.list_(pa.int32())), pa.array(nodes, pa.list_(pa.int64()))],
                names=[key, "class", "shingles", "nodes"],
            )

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("class", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.IntegerType())), T.StructField("nodes", T.ArrayType(T.LongType()))])
    everything = written(df.select(F.col(key), F.col(text).cast("string")).mapInArrow(sign, schema), "signed")
    members, signed = everything.select("class", key), everything.filter("nodes is not null").select("class", "shingles", "nodes")
    # one number per class keeps the join rows short; two classes of one number would both be verified
    number = F.xxhash64("class")
    at = signed.select(number.alias("c"), F.size("shingles").alias("n"), F.explode("nodes").alias("node"))
    sizes = at.groupBy("node").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    shared = at.join(sizes, "node")
    blocks = F.ceil(F.col("m") / node_block).cast("int")
    own = F.pmod(F.xxhash64("c", F.lit(1)), blocks).cast("int")
    left = shared.select("node", "c", "n", own.alias("p"), blocks.alias("k"))
    # block p meets block q in the group (p, q), p <= q: every two members meet exactly once
    first = left.select("node", "c", "n", "p", F.explode(F.sequence("p", F.col("k") - 1)).alias("q"))
    second = left.select(F.col("node").alias("node2"), F.col("c").alias("d"), F.col("n").alias("n2"), F.col("p").alias("q2"), F.explode(F.sequence(F.lit(0), "p")).alias("p2"))
    met = (
        first.join(second, (F.col("node") == F.col("node2")) & (F.col("p") == F.col("p2")) & (F.col("q") == F.col("q2"))
                   & F.when(F.col("p") == F.col("q"), F.col("c") < F.col("d")).otherwise(F.col("c") != F.col("d"))
                   & (F.least("n", "n2") >= threshold * F.greatest("n", "n2")))
        .select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()
    )
    sets = signed.select(number.alias("c"), "class", "shingles")
    met = written(met, "met")
    needed = met.select(F.explode(F.array("c", "d")).alias("c")).distinct()
    sets = written(sets.join(needed, "c", "left_semi").dropDuplicates(["class"]), "sets")
    pairs = (
        met.join(sets.select("c", F.col("class").alias("class_a"), F.col("shingles").alias("x")), "c")
        .join(sets.select(F.col("c").alias("d"), F.col("class").alias("class_b"), F.col("shingles").alias("y")), "d")
    )

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(f["x"], f["y"])), np.int64, len(f))
            every = f["x"].map(len).to_numpy(np.int64) + f["y"].map(len).to_numpy(np.int64) - both
            similarity = both / np.maximum(every, 1)
            yield f[["class_a", "class_b"]].assign(similarity=similarity)[similarity >= threshold]

    links = pairs.select("class_a", "class_b", "x", "y").mapInPandas(verify, "class_a binary, class_b binary, similarity double")
    return members, links


def duplicate_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(a, b, similarity), a < b: every two keys of one class or of linked classes."""
    one, two = members.distinct(), members.select(F.col("class").alias("class2"), F.col(key).alias("b")).distinct()
    one = one.withColumnRenamed(key, "a")
    copies = one.join(two, (F.col("class") == F.col("class2")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1.0).alias("similarity"))
    linked = (
        links.join(one, F.col("class_a") == F.col("class")).select("a", "class_b", "similarity")
        .join(two, F.col("class_b") == F.col("class2"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    )
    return copies.unionByName(linked)
