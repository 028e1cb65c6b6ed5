"""Encoding whole corpora with a public byte-level BPE vocabulary.

Speculate and verify. A greedy longest match proposes the tokens of a word. A
sequence of tokens is the BPE encoding of its bytes exactly when every two adjacent
tokens, joined and merged afresh, give the same two tokens again, so the proposals of
all new words of a batch are tested as one array of distinct adjacent pairs. Only words
with a failing pair go through exact merging.

Text is first cut at single blanks between two other characters, where every split
pattern of this family starts a new word; such pieces repeat so often that most of a
corpus is answered from a table of pieces already encoded.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the driver of this project keeps public vocabularies; a parameter everywhere.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept encoded and pairs kept tested per worker; a table is emptied when it is full, which only costs time.
KEPT_PAIRS = 2_000_000
KEPT_PIECES = 400_000
#: Characters handled at once, to bound a worker's memory whatever the batch holds.
CHUNK_CHARS = 4_000_000
_SHORT = 48
#: A blank inside a longer run of white space, where cutting is not safe.
_RUN = re.compile(r"[^\S ] (?:\s|\Z)").search


class Encoder:
    """The encoder of one rank file; one per worker process and file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str = RANKS) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.longest = max(map(len, self.ranks))
        self.bytes_of = {rank: word for word, rank in self.ranks.items()}
        # Rust's \s is the White_Space property, without the four separators U+001C to U+001F
        self.words_of = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")).findall
        self.pairs = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.merged_words = self.seen_words = 0
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat = np.empty(0, np.int32)
        self.start = np.zeros(2, np.int64)

    # -- exact merging

    def merge(self, word: bytes) -> list[int]:
        """The encoding of one word by merging its lowest-ranked pair again and again."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._merge_short(word) if len(word) <= _SHORT else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap over a linked list: n log n for words without any blank."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # of the part that starts at i; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(word[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return ids

    # -- speculate and verify

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        ids, i, n, get = [], 0, len(word), self.ranks.get
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (rank := get(word[i:j])) is not None:
                    ids.append(rank)
                    i = j
                    break
        return ids

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For keys left << 32 | right: whether the two tokens stay apart when merged afresh."""
        at = np.searchsorted(self.pairs, pairs)
        known = np.zeros(len(pairs), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == pairs[inside]
        new = np.unique(pairs[~known])
        if len(new):
            fresh = np.fromiter((self.merge(self.bytes_of[p >> 32] + self.bytes_of[p & 0xFFFFFFFF]) == [p >> 32, p & 0xFFFFFFFF] for p in new.tolist()), bool, len(new))
            place = np.searchsorted(self.pairs, new)  # both are sorted, so new pairs are put in their places
            self.pairs, self.fits = np.insert(self.pairs, place, new), np.insert(self.fits, place, fresh)
            at = np.searchsorted(self.pairs, pairs)
        out = self.fits[at]
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs, self.fits = self.pairs[:0].copy(), self.fits[:0].copy()
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces and add them to the table."""
        words: dict[str, int] = {}
        split = []
        for piece in pieces:
            split.append([words.setdefault(w, len(words)) for w in self.words_of(piece)])
        spelled = [w.encode() for w in words]
        proposed = [self.propose(w) for w in spelled]
        flat = np.fromiter(chain.from_iterable(proposed), np.int64)
        owner = np.repeat(np.arange(len(proposed)), np.fromiter(map(len, proposed), np.int64, len(proposed)))
        if len(flat) > 1:
            joint = owner[1:] == owner[:-1]
            bad = ~self.compatible((flat[:-1] << 32 | flat[1:])[joint])
            failing = np.unique(owner[1:][joint][bad]).tolist()
            for i in failing:
                proposed[i] = self.merge(spelled[i])
            self.merged_words += len(failing)
        self.seen_words += len(words)
        base = len(self.index)
        self.index.update((piece, base + i) for i, piece in enumerate(pieces))
        ids = [list(chain.from_iterable(proposed[w] for w in one)) for one in split]
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
        ends = self.start[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.start = np.concatenate([self.start, ends])

    def _pieces(self, text: str) -> list[str]:
        """Parts of a text whose encodings can be joined."""
        if "  " in text or _RUN(text):
            return self.words_of(text)
        parts = text.split(" ")
        first = parts[0]
        out = [" " + p for p in parts]
        if first:
            out[0] = first
        else:
            del out[0]
        return out

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        per_text = [self._pieces(t) if t else [] for t in texts]
        if len(self.index) > KEPT_PIECES:
            self._forget()
        index = self.index
        if new := [p for p in dict.fromkeys(chain.from_iterable(per_text)) if p not in index]:
            self._learn(new)
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(per_text)), np.int64)
        sizes = self.start[at + 1] - self.start[at]
        done = np.cumsum(sizes)
        within = np.arange(done[-1] if len(done) else 0) - np.repeat(done - sizes, sizes)
        ids = self.flat[np.repeat(self.start[at], sizes) + within]
        pieces = np.cumsum(np.fromiter(map(len, per_text), np.int64, len(per_text)))
        ends = np.concatenate([[0], done])[pieces] if len(per_text) else pieces
        return ids, ends


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about CHUNK_CHARS characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size > CHUNK_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(key, ids array<int>): the token ids of every text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give
    the empty list, blank texts the ids of their blanks. Repeated rows give repeated
    rows; a null key stays null; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for batch in batches:
            done = 0
            for part in chunks(batch.column(1).to_pylist()):
                ids, ends = encoder.encode(part)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), lists], names=[key, "ids"])
                done += len(part)

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(key, n_tokens bigint): the length of each list that encode_corpus gives, without building it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for batch in batches:
            sizes = [np.diff(encoder.encode(part)[1], prepend=0) for part in chunks(batch.column(1).to_pylist())]
            sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
