"""Ranking documents: BM25, exact vector similarity, fusion, significant terms.

A ranking has the columns id, score and rank (1 is best; ties go to the smaller id).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import near_dup_key, tokens
from ..session import written

#: BM25 constants, digits that scores are rounded to, and the constant of rank fusion (fixed values).
K1, B, DIGITS, RANK_CONSTANT = 1.2, 0.75, 6, 60
KEYWORD_BOOST = 2.0
#: Postings in a slice of the documents and queries in a block, of which one worker holds a pair at a time.
SLICE_POSTINGS, BLOCK_QUERIES = 1_000_000, 16_384


def query_terms(text: str) -> list[str]:
    """The different tokens of a query, as the tokenizer of documents gives them."""
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}_]+", text.lower())))


def top(scored: DataFrame, size: int, key: str = "id") -> DataFrame:
    """The `size` best rows of (key, score), with rank; one sort of the survivors of a distributed top-k."""
    best = scored.orderBy(F.desc("score"), F.asc(key)).limit(size)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))))


def bm25(docs: DataFrame, boosts: dict[str, float], key: str, text: str) -> DataFrame:
    """(id, score) of the documents that hold a query term; boosts weighs each term.

    Nothing is exploded or shuffled but two sums: a document's term frequencies are counted in
    its own token array, and one aggregate row gives the collection's statistics.
    Null texts have no tokens; they count as documents of length 0.
    """
    terms = sorted(boosts)
    if not terms:
        return docs.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).filter("false")
    # one array of frequencies, not a column per term: constraint inference grows fast with the number of columns
    counts = F.transform(F.array(*(F.lit(w) for w in terms)), lambda w: F.size(F.filter(F.col("toks"), lambda t: t == w)))
    # exploding a list of one keeps the optimizer from repeating tokens and counts in every expression that uses them
    rows = docs.select(F.col(key).alias("id"), F.explode(F.array(tokens(F.col(text)))).alias("toks"))
    counted = rows.select("id", F.size("toks").alias("dl"), F.explode(F.array(counts)).alias("tfs"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.get("tfs", i) > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))).first()
    if not stats["n"] or not stats["avgdl"]:
        return counted.select("id", F.lit(0.0).alias("score")).filter("false")
    n = stats["n"]
    weights = F.array(*(F.lit(float(boosts[w]) * math.log(1.0 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))) for i, w in enumerate(terms)))
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(float(stats["avgdl"])))
    parts = F.zip_with("tfs", weights, lambda tf, w: w * tf.cast("double") * (K1 + 1) / (tf.cast("double") + norm))
    score = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
    return counted.filter(F.exists("tfs", lambda tf: tf > 0)).select("id", F.round(score, DIGITS).alias("score"))


def boosted_terms(keywords: str, profile: str, keyword_boost: float = KEYWORD_BOOST) -> dict[str, float]:
    """Weights of a two-clause query: keywords count keyword_boost, the profile's words 1."""
    boosts: dict[str, float] = {}
    for w in query_terms(keywords):
        boosts[w] = boosts.get(w, 0.0) + keyword_boost
    for w in query_terms(profile):
        boosts[w] = boosts.get(w, 0.0) + 1.0
    return boosts


def knn(vectors: DataFrame, query: Sequence[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score): exact cosine similarity with a query vector. Null vectors, vectors of
    another length and zero vectors give no row."""
    q = [float(x) for x in query]
    length = sum(x * x for x in q) ** 0.5
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, F.array(*(F.lit(x) for x in q)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.filter(F.size(vector) == len(q)).select(F.col(key).alias("id"), dot.alias("d"), norm.alias("n")).filter("n > 0")
    return rows.select("id", F.round(F.col("d") / (F.col("n") * F.lit(length)), DIGITS).alias("score"))


def rrf(first: DataFrame, second: DataFrame, constant: int = RANK_CONSTANT) -> DataFrame:
    """(id, score): reciprocal rank fusion of two rankings; a list that lacks an id adds nothing."""
    a, b = first.select("id", F.col("rank").alias("r1")), second.select("id", F.col("rank").alias("r2"))
    one = lambda r: F.coalesce(1.0 / (constant + F.col(r)), F.lit(0.0))
    return a.join(b, "id", "full").select("id", F.round(one("r1") + one("r2"), 9).alias("score"))


def min_max(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(id, score): each ranking scaled to 0..1 within itself, then the weighted mean. Weights
    are scaled to sum 1. A ranking of equal scores scales to 1."""
    total = sum(weights)
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must be positive")

    def scaled(ranking: DataFrame, name: str) -> DataFrame:
        ends = ranking.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        value = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        return ranking.crossJoin(F.broadcast(ends)).select("id", value.alias(name))  # one row of ends

    both = scaled(first, "s1").join(scaled(second, "s2"), "id", "full")
    mean = (F.coalesce("s1", F.lit(0.0)) * weights[0] + F.coalesce("s2", F.lit(0.0)) * weights[1]) / total
    return both.select("id", F.round(mean, DIGITS).alias("score"))


def discover(docs: DataFrame, profile: str, keywords: str | None = None, vectors: DataFrame | None = None, query: Sequence[float] | None = None,
             size: int = 50, fusion: str = "rrf", key: str = "doc_id", text: str = "text", vector_key: str = "vec_id", vector: str = "embedding",
             weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(id, score, rank): hybrid ranking if vectors and a query vector are given, else BM25.

    Keywords default to the profile. fusion is "rrf" or "normalization".
    """
    if fusion not in ("rrf", "normalization"):
        raise ValueError(f"unknown fusion: {fusion}")
    lexical = bm25(docs, boosted_terms(keywords or profile, profile), key, text)
    if vectors is None or query is None:
        return top(lexical, size)
    one, two = top(lexical, size), top(knn(vectors, query, vector_key, vector), size)
    return top(rrf(one, two) if fusion == "rrf" else min_max(one, two, weights), size)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, id, tf, dl): the inverted index, for many queries at once. Counting by document
    and term combines on the map side; write it bucketed by term to reuse it."""
    toks = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("toks"))
    return toks.select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def _asked_postings(docs: DataFrame, queries: DataFrame, key: str, text: str) -> tuple[DataFrame, int, float]:
    """(term, id, dl, tf) of the terms that queries (query, term) ask for, with the number of
    documents and their mean length."""
    n, avgdl = docs.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count("*"), F.avg("dl")).first()
    # terms nobody asks for leave before anything is grouped
    toks = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("toks")).select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return toks.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "dl").agg(F.count("*").alias("tf")), n, float(avgdl or 1)


def _weighted(index: DataFrame, n: int, avgdl: float) -> DataFrame:
    """(term, id, part): what a posting adds to the BM25 score of its document."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return index.join(df, "term").select("term", "id", part.alias("part"))


def bm25_many(docs: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, id, score) for a table of queries (query, term), all in one job."""
    parts = _weighted(*_asked_postings(docs, queries, key, text))
    return queries.join(parts, "term").groupBy("query", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def _ahead(postings: pa.Table, asks: pa.Table) -> pa.Table:
    """(query, ahead): how many documents of postings (term, id, part) stand before each query's
    (query, terms, id, score), by score and then id. All scores of a query are one array."""
    term, ids = (postings[c].combine_chunks().dictionary_encode() for c in ("term", "id"))
    by_term = np.argsort(term.indices.to_numpy(), kind="stable")
    ends = np.cumsum(np.bincount(term.indices.to_numpy(), minlength=len(term.dictionary)))
    sort = pc.sort_indices(ids.dictionary)
    names, place = ids.dictionary.take(sort).to_pylist(), np.empty(len(sort), np.int64)
    place[sort.to_numpy()] = np.arange(len(sort))
    doc, part = place[ids.indices.to_numpy()[by_term]], postings["part"].to_numpy()[by_term]
    terms = asks["terms"].combine_chunks()
    wanted = pc.fill_null(pc.index_in(terms.flatten(), value_set=term.dictionary), -1).to_numpy()
    stops = np.cumsum(pc.list_value_length(terms).to_numpy())
    bests, ahead = np.rint(asks["score"].to_numpy() * 10**DIGITS), np.zeros(len(asks), np.int64)
    for i, (stop, own) in enumerate(zip(stops, asks["id"].to_pylist(), strict=True)):
        at = [slice(ends[t - 1] if t else 0, ends[t]) for t in wanted[stops[i - 1] if i else 0 : stop] if t >= 0]
        if at:
            total = np.bincount(np.concatenate([doc[a] for a in at]), np.concatenate([part[a] for a in at]), len(names))
            score, before = np.rint(total * 10**DIGITS), bisect_left(names, own)
            # a score may round to 0; documents without any term have no place in the ranking
            ahead[i] = np.count_nonzero(score > bests[i]) + np.count_nonzero((score[:before] == bests[i]) & (total[:before] > 0))
    return pa.table({"query": asks["query"], "ahead": ahead})


def best_ranks(docs: DataFrame, queries: DataFrame, marked: DataFrame, key: str, text: str, slice_postings: int = SLICE_POSTINGS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query, id, rank): the best of each query's targets and its rank among all documents that
    bm25_many scores for the query. marked (query, id, target) names documents of a query: its
    targets, and with target false those its ranking leaves out. A query none of whose targets
    holds a term of it has no row. Ids are not null; queries are read several times, so write
    them first.

    The ranking itself, queries times documents, is never a table. Targets are scored by a join;
    then slices of the documents meet blocks of the queries, and of each pair of those only the
    number of documents ahead of a query's target is kept."""
    index, n, avgdl = _asked_postings(docs, queries, key, text)
    index = written(index, "postings")
    parts = _weighted(index, n, avgdl)
    own = marked.join(queries, "query").join(parts, ["term", "id"]).groupBy("query", "id", "target").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    placed = own.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    # what stands before the first target among a query's own documents is left out
    best = written(placed.filter("target").groupBy("query").agg(F.min(F.struct("place", "id", "score")).alias("b")).select("query", "b.id", "b.score", (F.col("b.place") - 1).alias("left_out")), "targets")
    slices, blocks = index.count() // slice_postings + 1, best.count() // block_queries + 1
    asks = queries.join(best, "query").groupBy("query", "id", "score").agg(F.collect_list("term").alias("terms")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    routes = asks.select("block", F.explode("terms").alias("term")).distinct()
    cells = parts.join(routes, "term").select(F.col("block").alias("of"), F.pmod(F.xxhash64("id"), F.lit(slices)).alias("cut"), "term", "id", "part")
    asked = asks.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))
    schema = T.StructType([best.schema["query"], T.StructField("ahead", T.LongType())])
    counted = cells.groupBy("of", "cut").cogroup(asked.groupBy("block", "slice")).applyInArrow(_ahead, schema)
    ahead = counted.groupBy("query").agg(F.sum("ahead").alias("ahead"))
    return best.join(ahead, "query").select("query", "id", (F.col("ahead") - F.col("left_out") + 1).cast("int").alias("rank"))


def significant_terms(docs: DataFrame, foreground: DataFrame, key: str, text: str, size: int = 30, min_doc_count: int = 3, drop_duplicates: bool = True) -> DataFrame:
    """(term, fg, bg, score): terms more common in the foreground ids than in all documents, by
    (fg% - bg%) * fg% / bg%, best first, ties by term. drop_duplicates counts texts with the
    same near-duplicate key once: the one of the smallest id, a foreground id first.

    The background is counted without a join; only the foreground's own texts meet its ids."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    ids = foreground.select(F.col(key).alias("id")).distinct()
    if drop_duplicates:
        marked = rows.select("id", near_dup_key(F.col("t")).alias("k")).join(ids.withColumn("in_fg", F.lit(True)), "id", "left")
        kept = marked.groupBy("k").agg(F.min_by("id", F.struct(F.col("in_fg").isNull(), F.col("id"))).alias("id")).select("id")
        rows = rows.join(kept, "id", "left_semi")
    terms = lambda r: r.select(F.explode(F.array_distinct(tokens(F.col("t")))).alias("term"))
    mine = rows.join(ids, "id", "left_semi")
    n, n_fg = rows.count(), mine.count()
    fg = terms(mine).groupBy("term").agg(F.count("*").alias("fg")).filter(F.col("fg") >= min_doc_count)
    bg = terms(rows).groupBy("term").agg(F.count("*").alias("bg"))
    f, b = F.col("fg") / F.lit(max(n_fg, 1)), F.col("bg") / F.lit(max(n, 1))
    return fg.join(bg, "term").filter(f > b).select("term", "fg", "bg", F.round((f - b) * (f / b), DIGITS).alias("score")).orderBy(F.desc("score"), "term").limit(size)


def hash_sample(docs: DataFrame, key: str, size: int, seed: int = 1) -> DataFrame:
    """A reproducible random sample: the `size` rows with the smallest MD5 of seed:id."""
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(size)


def candidates(ranked: DataFrame, docs: DataFrame, key: str, text: str, index: str, stamp: Column | None = None) -> DataFrame:
    """(doc_id, index, score, timestamp, text) of a ranking, ids missing from docs dropped.
    A ranking is a top-k, so it is the small side of the join."""
    rows = docs.select(F.col(key).alias("id"), (stamp if stamp is not None else F.lit(None).cast("timestamp")).alias("timestamp"), F.col(text).alias("text"))
    return ranked.join(rows, "id").select(F.col("id").alias("doc_id"), F.lit(index).alias("index"), "score", "timestamp", "text")
