import random

import pytest
from pyspark.sql import Row

from veilstone.llm import packing, tokens

tiktoken = pytest.importorskip("tiktoken")


def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_encoder():
    rnd = random.Random(7)
    texts = ["", " ", "  \n a", "don't stop", "x<|endoftext|>y", "a" * 5000 + "b", "的" * 300, "é ñ ​ 🙂🙂", "tab\t\tend ", "\x1c\x1d a \x85 b"]
    texts += ["".join(rnd.choice(" \n\t\xa0ab1'sé中.") for _ in range(rnd.randrange(40))) for _ in range(500)]
    ids, ends = tokens.Encoder.of().encode([*texts, None])
    enc, at = reference(), 0
    for t, end in zip([*texts, ""], ends.tolist()):
        assert ids[at:end].tolist() == enc.encode_ordinary(t), repr(t)
        at = end


def test_speculation_is_verified_not_trusted():
    e = tokens.Encoder(tokens.RANKS)
    words = [" speculation", " untokenisable", "xqzj", " 12345678901"]
    e.encode(words)
    assert 0 < e.merged_words <= e.seen_words
    assert all(e.merge(w.encode()) == reference().encode_ordinary(w) for w in words)


def test_encode_corpus_defined_cases(spark):
    df = spark.createDataFrame([Row(doc_id=1, text=None, ids="clash"), Row(doc_id=2, text="", ids="x"), Row(doc_id=2, text="", ids="x"), Row(doc_id=None, text=" ", ids="y")])
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (2, []), (None, [220])], key=str)
    assert tokens.encode_corpus(df.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_layout_is_valid_and_close_to_the_bound(seed):
    rnd = random.Random(seed)
    counts: dict[int, int] = {}
    for _ in range(rnd.randrange(1, 400)):
        s = rnd.randrange(1, 2049) if seed % 2 else rnd.choice([100, 700, 1000, 1100, 2000, 2048])
        counts[s] = counts.get(s, 0) + 1
    layout = packing.solve(counts)
    used, placed = {}, {}
    for size, rank, first, n in layout.runs:
        placed.setdefault(size, []).extend(range(rank, rank + n))
        for i in range(n):
            used[first + i] = used.get(first + i, 0) + size
    assert all(sorted(placed[s]) == list(range(c)) for s, c in counts.items())
    assert max(used.values()) <= 2048 and len(used) == layout.containers
    assert layout.containers <= 1.23 * -(-sum(s * c for s, c in counts.items()) // 2048) + 1


def test_dominance_matches_exhaustive_search():
    from itertools import combinations

    def best(items, capacity):
        items = sorted(items, reverse=True)
        found = [len(items)]

        def place(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(items):
                found[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return found[0]

    rnd = random.Random(3)
    for _ in range(60):
        items = [rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9))]
        counts = {s: items.count(s) for s in items}
        j = max(items)
        group = packing.dominating_set(j, counts, sorted(counts), 20)
        if group is not None:
            rest = list(items)
            for s in (j, *group):
                rest.remove(s)
            assert best(rest, 20) + 1 == best(items, 20), (items, group)
    assert list(combinations([1, 2], 2)) == [(1, 2)]


def test_packing_divides_only_what_must_be(spark):
    rows = [Row(doc_id=1, n_tokens=5000), Row(doc_id=2, n_tokens=0), Row(doc_id=3, n_tokens=None), Row(doc_id=4, n_tokens=2048), Row(doc_id=5, n_tokens=10), Row(doc_id=5, n_tokens=10)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    for block in (100_000, 1):
        got = packing.pack_sized(df, rank_block=block).collect()
        assert sorted((r.doc_id, r.part, r.n_tokens) for r in got if r.doc_id) == [(1, 0, 2048), (1, 1, 2048), (1, 2, 904), (2, 0, 0), (3, 0, 0), (4, 0, 2048), (5, 0, 10), (5, 0, 10)]
        fill: dict[int, int] = {}
        for r in got:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        assert max(fill.values()) <= 2048 and len(fill) == 4
    assert packing.pack_sized(df.filter("false")).count() == 0


def test_hot_size_is_ranked_in_blocks(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 700, id % 2048) as n_tokens")
    got = packing.pack_sized(df, rank_block=50)
    worst = got.groupBy("container").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0]
    assert worst <= 2048 and got.count() == 3000


def test_emptied_tables_change_nothing(monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(1, 14))) for _ in range(30)) for _ in range(40)]
    whole = tokens.Encoder(tokens.RANKS)
    expected = [whole.encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(tokens, "KEPT_PAIRS", 5)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 20)
    small = tokens.Encoder(tokens.RANKS)
    assert [small.encode([t])[0].tolist() for t in texts] == expected and len(small.pairs) <= 5
    assert (whole.pairs[1:] > whole.pairs[:-1]).all()
