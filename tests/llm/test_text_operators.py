import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Row

from veilstone.llm import distinctive, near, repetition, splitting


# -- splitting

def test_pieces_cover_the_text_with_overlap(spark):
    text = ("Sentence number one ends here. " * 300) + "\n\nII. Discussion\n" + ("More words follow, and more; " * 300)
    rows = [Row(k=1, message=text), Row(k=2, message=None), Row(k=3, message=""), Row(k=4, message="x" * 20000), Row(k=5, message="短" * 6000)]
    got = splitting.split_oversized(spark.createDataFrame(rows, "k int, message string"), "k").orderBy("k", "piece").collect()
    by = {k: [r for r in got if r.k == k] for k in (1, 3, 4, 5)}
    assert not [r for r in got if r.k == 2]
    assert [(r.piece, r.text) for r in by[3]] == [(0, "")] and len(by[5]) == 1
    for k, t in ((1, text), (4, "x" * 20000)):
        assert all(len(r.text) <= 6000 for r in by[k])
        assert "".join(t[r.start : r.end] for r in by[k]) == t
        assert all(r.text == t[max(0, r.start - 200) : r.end] for r in by[k])
    assert any(t.start == text.index("II. Discussion") for t in by[1]) or len(by[1]) == 4


def test_section_heads_are_told_from_mentions():
    body = " The court held the lease void. As part III. of the Lease Act provides, no will binds. "
    text = "Intro." + body + "-- Damages --" + body + "[II] Analysis" + body + "§ 3 Facts" + body + "* * *" + body + "STANDARD OF REVIEW" + body + "1. Facts" + body + "2. Discussion" + body
    heads = splitting.section_starts(text)
    expected = [0, *(text.index(h) for h in ("-- Damages", "[II]", "§ 3", "* * *", "STANDARD", "1. Facts", "2. Disc"))]
    assert heads == sorted(expected)
    assert splitting.section_starts("no heads at all, just words") == [0]


@pytest.mark.parametrize("length", [1, 6000, 6001, 11800, 11801, 40000])
def test_piece_count_is_minimal_without_boundaries(length):
    cuts = splitting.balanced_cuts(length, [])
    assert len(cuts) + 1 == 1 + max(0, math.ceil((length - 6000) / 5800))


# -- distinctive terms

def test_ppmi_against_brute_force(spark):
    texts = {1: "alpha beta beta gamma", 2: "beta delta delta delta alpha", 3: None, 4: "", 5: "no"}
    df = spark.createDataFrame([Row(k=k, message=t, df="clash") for k, t in texts.items()], "k int, message string, df string")
    got = {(r.k, r.term): (r.tf, r.df, r.ppmi) for r in distinctive.term_scores(df, "k").collect()}
    counts = {k: Counter(distinctive.terms(t)) for k, t in texts.items()}
    z = sum(sum(c.values()) ** 0.75 for c in counts.values() if c)
    for k, c in counts.items():
        for w, tf in c.items():
            n_t = sum(x[w] for x in counts.values())
            expected = max(0.0, math.log(tf * z / (n_t * sum(c.values()) ** 0.75)))
            assert got[k, w] == (tf, sum(w in x for x in counts.values()), pytest.approx(expected))
    assert len(got) == sum(map(len, counts.values()))
    assert distinctive.term_scores(df.filter("false"), "k").count() == 0


# -- near duplicates

def jaccard(a, b, n):
    x, y = (set(zip(*(near.words(t)[i:] for i in range(n)))) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_near_duplicates_equal_brute_force(spark):
    rnd = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(400)]
    base = [" ".join(rnd.choice(vocabulary, 80)) for _ in range(25)]
    texts = list(base)
    for t in base[:15]:
        for _ in range(3):
            w = t.split()
            for i in rnd.integers(0, len(w), rnd.integers(1, 6)):
                w[i] = "edit"
            texts.append(" ".join(w))
    texts += [base[0].upper() + "!", base[0]]
    rows = [Row(k=i, message=t) for i, t in enumerate(texts)] + [Row(k=900, message=None), Row(k=901, message="short text"), Row(k=0, message=texts[0])]
    df = spark.createDataFrame(rows, "k bigint, message string")
    expected = {(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b], 3) >= 0.7}
    for block in (256, 2):
        members, links = near.near_duplicates(df, "k", "message", 3, 0.7, 30, node_block=block)
        pairs = {(r.a, r.b) for r in near.duplicate_pairs(members, links, "k").collect()}
        assert pairs == expected
    members, links = near.near_duplicates(df.filter("false"), "k")
    assert members.count() == 0 and links.count() == 0


def test_prefix_is_shortened_to_the_recall():
    for t in (0.5, 0.7, 0.8, 0.9):
        d = near.prefix_depth(t)
        assert 1 - (1 - t**d) ** near.TREES >= near.RECALL or d == 1
        assert d == near.DEPTH or 1 - (1 - t ** (d + 1)) ** near.TREES < near.RECALL


# -- repetition

def slow_share(text):
    w = [x for x in re.split("[ \t\n\r]+", text.lower()) if x]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    return len(covered) / len(w) if w else 0.0


def test_repeated_share_and_scores(spark):
    rnd = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(240):
        w = list(rnd.choice(vocabulary, rnd.integers(5, 200)))
        if i % 4 == 0:
            w += w[: rnd.integers(8, 60)] * int(rnd.integers(1, 5))
        texts.append(" ".join(w))
    texts += ["", " \n\t ", "a " * 500, "Überall überall " * 30]
    assert all(repetition.repeated_share(t) == pytest.approx(slow_share(t)) for t in texts)
    df = spark.createDataFrame([Row(doc_id=i, text=t, probability="clash") for i, t in enumerate(texts)] + [Row(doc_id=999, text=None, probability="")], "doc_id bigint, text string, probability string")
    found = {r.doc_id for r in repetition.score_repetition(df).filter("is_repetitive").collect()}
    expected = {i for i, t in enumerate(texts) if slow_share(t) >= 0.3}
    assert len(expected & found) >= 0.98 * len(expected) and found <= expected
    assert repetition.score_repetition(df.filter("doc_id = 240")).first().is_repetitive is False
    assert repetition.score_repetition(df.filter("false")).count() == 0


def test_every_document_gets_its_exact_share(spark):
    rnd = np.random.default_rng(3)
    texts = []
    for i in range(200):
        w = [f"w{k}" for k in rnd.integers(0, 5000, rnd.integers(60, 200))]
        for _ in range(i % 5):
            # isolated runs of eight words, repeated far apart
            at, to = rnd.integers(0, len(w) - 8, 2)
            w[to:to] = w[at : at + 8] + [f"x{rnd.integers(0, 5000)}"]
        texts.append(" ".join(w))
    texts += ["", "a " * 500]
    rows = [Row(doc_id=i, text=t) for i, t in enumerate(texts)] + [Row(doc_id=999, text=None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = {i: slow_share(t) for i, t in enumerate(texts)} | {999: 0.0}
    scored = repetition.score_repetition(df).collect()
    assert {r.doc_id: r.repeated_share for r in scored} == pytest.approx(expected)
    assert all(r.is_repetitive == (expected[r.doc_id] >= 0.3) for r in scored)
    for run in (3, 8, 11):
        got = repetition.features_and_repeats(texts, run)[1].tolist()
        assert got == [repetition.repeated_share(t, run) > 0 for t in texts]


def test_classifier_decides_and_loses_no_repetitive_document(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    rows = []
    for k in range(400):
        # runs repeated far apart, one by one, so that the share lies on either side of 0.3
        new = [word() for _ in range(400)]
        runs = [[word() for _ in range(8)] for _ in range(k % 25)]
        rows.append((k, " ".join(new + [w for r in runs for w in (*r, word())] + [w for r in runs for w in (*r, word())])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = repetition.score_repetition(df).collect()
    exact = {k: repetition.repeated_share(t) for k, t in rows}
    assert {r.doc_id: r.repeated_share for r in got} == exact
    true = {k for k, s in exact.items() if s >= 0.3}
    assert true and {r.doc_id for r in got if r.is_repetitive} == true
    passed = {r.doc_id for r in got if r.probability >= repetition.PASSES}
    assert true <= passed and len(passed) < 0.8 * len(rows)  # most others never reach the check
    assert not [r for r in repetition.score_repetition(df, passes=1.1).collect() if r.is_repetitive]
    x = repetition.features([t for _, t in rows])
    found, positives = repetition.fit(x, np.array([exact[k] >= 0.3 for k, _ in rows])).held_out
    assert found == positives > 0
