"""Linking the spellings of one person's or firm's name.

Suffix blocking. Every spelling is indexed by the suffixes of its words. A suffix alone says
little ("well" ends hundreds of surnames), so before any is given up it is refined with the
other fields of the entries a spelling was seen in: the address it stood beside tells
surname, first name and hence the person. Spellings that meet in a refined block are
compared by the ratio of their longest common subsequence, neighbours first; what agrees
with no neighbour is compared with all spellings of its person, and a spelling that agrees
with none of them is left out.

A spelling is linked through persons: "T. Hill" may stand for two people and is then linked
to the spellings of both, which stay apart. A spelling that stood beside no address of its
own joins every person with a spelling that says the same word by word; one that fits nobody
is linked to the other spellings without address that do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.packed import Segmenter, joined
from ..session import written
from .fresh import fold

MIN_SUFFIX, RATIO = 4, 0.7
#: Parts by hash into which a person's spellings are cut when the rest is compared with all of them.
PARTS = 8
#: Share of the longer word that two words have to have in common, more than which shows one with a slip.
ALIKE = 0.8
#: Words that say nothing about who is named (fixed values).
_EMPTY_WORDS = {"the", "inc", "co", "corp", "llc", "ltd", "lp", "llp", "company", "corporation", "group", "grp", "jr", "sr", "ii", "iii", "esq"}
_ROLES = ("info", "billing", "notices", "office", "contact", "sales", "admin", "support", "mail", "service")


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Longest common subsequence over the shorter length."""
    return common(a, b) / min(len(a), len(b)) if a and b else 0.0


def words_of(spelling: str) -> list[str]:
    """Folded words of a spelling without its remark."""
    return fold(re.sub(r"\([^)]*\)", " ", spelling)).split()


def owner(address: str) -> tuple[str, str, bool]:
    """(surname, first name or its beginning or '', whether a firm) that an address names."""
    local = fold(address.split("@")[0]).strip()
    if m := re.fullmatch(r"(\S+) (\S+)", local):
        a, b = m.groups()
        if a in _ROLES:
            return b, "", True
        if re.fullmatch(r"[a-z]{1,3}\d+", b):
            return a, b.rstrip("0123456789"), False
        return b.rstrip("0123456789"), a, False
    bare = local.rstrip("0123456789").replace(" ", "")
    return (bare, "", False) if bare != local else (bare[1:], bare[:1], False)


def best_order(words: list[str], surname: str) -> tuple[str, str]:
    """(surname as typed, longest other word): the word most like the known surname, the
    initial of a short address allowed for."""
    if not words:
        return "", ""
    score = lambda w: (common(w, surname) / max(len(w), len(surname), 1), len(w))
    last = max(words, key=score)
    rest = [w for w in words if w is not last]
    return last, max(rest, key=len, default="")


def alike(a: str, b: str) -> bool:
    """Whether two words are one, a slip in a longer one allowed for."""
    return a == b or common(a, b) > ALIKE * max(len(a), len(b))


def stands_for(a: str, b: str) -> bool:
    """Whether two words can be one name: alike, an initial, a beginning or a pet form in -ie or -y."""
    short, long = sorted((a, b), key=len)
    if len(short) < 3:
        return short[:1] == long[:1]
    if alike(a, b) or long.startswith(short):
        return True
    stems = ((re.sub(r"(.)\1?(?:ie|y)$", r"\1", x), y) for x, y in ((a, b), (b, a)) if x.endswith(("ie", "y")))
    return any(len(stem) > 2 and y.startswith(stem) for stem, y in stems)


def naming(spelling: str) -> list[str]:
    """Words that name somebody; all words if there is no such word."""
    words = words_of(spelling)
    return [w for w in words if w not in _EMPTY_WORDS] or words


def surname_of(spelling: str) -> str:
    """The surname by the order of the words: before a comma, else the last."""
    left, _, right = re.sub(r"\([^)]*\)", " ", spelling).partition(",")
    named = [w for w in words_of(right) if w not in _EMPTY_WORDS]
    return (naming(left if named else spelling) or [""])[-1]


def same_name(a: list[str], b: list[str], surname: str) -> bool:
    """Whether two lists of words name the same, with a surname in the first: the words are
    equal, or each of the shorter list has its own counterpart in the longer one."""
    if sorted(a) == sorted(b):
        return bool(a)
    short, free = (a, list(b)) if len(a) <= len(b) else (b, list(a))
    left = []
    for w in short:
        free.remove(w) if w in free else left.append(w)
    for w in sorted(left, key=len, reverse=True):
        other = next((o for o in free if stands_for(w, o)), None)
        if other is None:
            return False
        free.remove(other)
    return len(short) > 1 and all(any(len(w) > 1 and alike(w, surname) for w in words) for words in (a, b))


def refined(spellings: DataFrame, min_suffix: int) -> DataFrame:
    """The columns and `block`: ends and beginnings of the words, each refined by the initial of another word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            blocks = []
            for s in f["spelling"]:
                ws = naming(s)
                others = [{o[0] for o in (*ws[:i], *ws[i + 1 :])} or {""} for i in range(len(ws))]
                blocks.append(sorted({part + c for w, cs in zip(ws, others) if len(w) > 1 for part in (f"-{w[-min_suffix:]} ", f"{w[:min_suffix]}- ") for c in cs}))
            yield f.assign(block=blocks).explode("block").dropna(subset=["block"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spellings.schema.fields)
    return spellings.mapInPandas(run, f"{kinds}, block string")


def attached(lone: DataFrame, owned: DataFrame, min_suffix: int, least: float) -> DataFrame:
    """(spelling, person) for the spellings without address: the persons one of whose
    spellings is met in a refined block and says the same."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for s, t, p in zip(f["spelling"], f["other"], f["person"]):
                a, b = naming(s), naming(t)
                known = p[1:].strip() if p.startswith("&") else p.strip()
                last = max(b, key=lambda w: (common(w, known.split(" ")[0]) / max(len(w), len(known.split(" ")[0])), len(w)), default="")
                keep.append(ratio(" ".join(sorted(a)), " ".join(sorted(b))) >= least and same_name(b, a, last))
            yield f.loc[keep, ["spelling", "person"]]

    met = refined(lone, min_suffix).join(refined(owned, min_suffix).withColumnRenamed("spelling", "other"), "block").select("spelling", "other", "person").distinct()
    return met.mapInPandas(compare, "spelling string, person string")


def unowned_pairs(lone: DataFrame, rest: DataFrame, min_suffix: int, least: float) -> DataFrame:
    """(name_a, name_b): spellings without address that say the same, at least one of them fitting no person."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for s, t in zip(f["spelling"], f["other"]):
                a, b = naming(s), naming(t)
                keep.append(ratio(" ".join(sorted(a)), " ".join(sorted(b))) >= least and any(same_name(a, b, last) for last in (surname_of(s), surname_of(t))))
            pairs = [(s, t) if s < t else (t, s) for s, t, k in zip(f["spelling"], f["other"], keep) if k]
            yield pd.DataFrame(pairs, columns=["name_a", "name_b"])

    met = refined(rest, min_suffix).join(refined(lone, min_suffix).withColumnRenamed("spelling", "other"), "block").filter("spelling <> other").select("spelling", "other").distinct()
    return met.mapInPandas(compare, "name_a string, name_b string").distinct()


def observations(df: DataFrame, sender: str, typed_sender: str, typed_to: str, to: str) -> DataFrame:
    """(spelling, unit, n): how often a spelling was seen beside an address. The address is the
    entry's own, else the sender header's for the typed sender, else the one at the same place
    of the address list if both lists have equally many entries; '' if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, addresses = Segmenter([]), Segmenter([], commas=False)
        for batch in batches:
            count: Counter[tuple[str, str]] = Counter()
            columns = [c.to_pylist() for c in batch.columns]
            for f, xf, xt, t in zip(*columns):
                mine = ""
                for name, address in names.entries(f) if f else ():
                    mine = address or mine
                    if name:
                        count[name, address] += 1
                for name, address in names.entries(xf) if xf else ():
                    if name:
                        count[name, address or mine] += 1
                if xt:
                    typed = names.entries(xt)
                    if any(name for name, _ in typed):
                        other = addresses.entries(joined(t)) if t else []
                        level = len(other) == len(typed)
                        for i, (name, address) in enumerate(typed):
                            if name:
                                count[name, address or (other[i][1] if level else "")] += 1
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in count], pa.string()), pa.array([u for _, u in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["spelling", "unit", "n"])

    rows = df.select(F.col(sender).cast("string"), F.col(typed_sender).cast("string"), F.col(typed_to).cast("string"), F.col(to))
    return rows.mapInArrow(run, "spelling string, unit string, n bigint").groupBy("spelling", "unit").agg(F.sum("n").alias("n"))


def persons(seen: DataFrame) -> DataFrame:
    """(spelling, person): every spelling with each person it was seen for. A person is a
    surname and a first name; units that lack the first name get the one most often typed
    beside them that fits, ties to the alphabet."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for spelling, unit in zip(f["spelling"], f["unit"]):
                surname, hint, firm = owner(unit)
                words = words_of(spelling)
                last, given = best_order(words, surname)
                likeness = max(ratio(last, surname) if len(last) > 2 else 0.0, 1.0 if firm and any(common(w, surname) >= 0.75 * len(surname) for w in words) else 0.0)
                # "Anna B": the first name with an initial
                if likeness < RATIO and given and (hint and (given.startswith(hint) or hint.startswith(given))) and any(w == surname[: len(w)] for w in words):
                    likeness = 1.0
                fits = len(given) > 2 and given != surname and ratio(given, surname) < 0.9
                out.append((surname, hint, firm, given if fits and not firm else "", likeness))
            yield f.assign(**{c: [o[i] for o in out] for i, c in enumerate(("surname", "hint", "firm", "given", "likeness"))})

    rows = seen.filter("unit <> ''").mapInPandas(parse, "spelling string, unit string, n bigint, surname string, hint string, firm boolean, given string, likeness double").filter(F.col("likeness") >= RATIO)
    rows = written(rows, "parsed")
    # whole first names in addresses decide; a beginning is completed by what is typed
    given = (
        rows.filter("given <> ''").withColumn("fits", F.col("given").startswith(F.col("hint")))
        .groupBy("unit", "given").agg(F.sum("n").alias("n"), F.max("fits").alias("fits"))
        .groupBy("unit").agg(F.max_by("given", F.struct("fits", "n", "given")).alias("typed"))
    )
    named = rows.join(given, "unit", "left").withColumn(
        "first", F.when(F.col("firm"), F.lit("")).when(F.length("hint") > 3, F.col("hint")).otherwise(F.coalesce("typed", "hint"))
    )
    return named.select("spelling", F.concat_ws(" ", F.when(F.col("firm"), F.lit("&")).otherwise(F.lit("")), "surname", "first").alias("person")).distinct()


def link_variants(df: DataFrame, sender: str = "mail_from", typed_sender: str = "x_from", typed_to: str = "x_to", to: str = "mail_to",
                  min_suffix: int = MIN_SUFFIX, least: float = RATIO) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: two different spellings of one person
    or firm.

    Null, blank and undisclosed headers have no entries; entries that are only an address
    have no spelling; a spelling that never stood for a known address is linked to the
    spellings that agree with it word by word (slips, initials, beginnings and pet forms
    allowed for) and to those of their persons. Repeated rows change nothing; other columns
    are ignored; no rows give no rows.
    """
    seen = written(observations(df, sender, typed_sender, typed_to, to), "seen")
    owned = written(persons(seen), "owned")
    # a spelling without any address joins the persons whose spellings have the same words or say the same
    same = F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(F.lower("spelling"), r"[^\p{L}\p{N}]+", " ")), " ")), " ")
    keyed = owned.withColumn("words", same)
    lone = written(seen.select("spelling").distinct().join(owned.select("spelling").distinct(), "spelling", "left_anti"), "lone")
    equal = lone.withColumn("words", same).join(keyed.select("words", "person").distinct(), "words").select("spelling", "person")
    nodes = written(owned.unionByName(equal).unionByName(attached(lone, owned, min_suffix, least)).distinct(), "nodes")
    apart = unowned_pairs(lone, lone.join(nodes.select("spelling").distinct(), "spelling", "left_anti"), min_suffix, least)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, p, " ".join(sorted(ws)), w[i:]) for s, p in zip(f["spelling"], f["person"]) for ws in (words_of(s),) for w in ws for i in range(max(len(w) - min_suffix, 0) + 1)]
            yield pd.DataFrame(rows, columns=["spelling", "person", "folded", "suffix"]).drop_duplicates()

    blocks = nodes.mapInPandas(index, "spelling string, person string, folded string, suffix string")
    # refined blocks; each spelling is compared with its neighbours in the block's order, which shows of most that they belong
    near = Window.partitionBy("person", "suffix").orderBy("folded", "spelling")
    met = blocks.select("spelling", "person", "folded", *(F.lag(c, k).over(near).alias(f"{c}{k}") for c in ("spelling", "folded") for k in (1, 2)))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, p, a, *rest in f[["spelling", "person", "folded", "spelling1", "folded1", "spelling2", "folded2"]].itertuples(index=False):
                for t, b in (rest[:2], rest[2:]):
                    if isinstance(t, str) and ratio(a, b) >= least:
                        rows += [(s, p), (t, p)]
            yield pd.DataFrame(rows, columns=["spelling", "person"]).drop_duplicates()

    agreed = met.mapInPandas(compare, "spelling string, person string").distinct()
    members = written(agreed.unionByName(_unmet(nodes, agreed, least)).distinct(), "members")
    a = members.select("person", F.col("spelling").alias("name_a"))
    b = members.select("person", F.col("spelling").alias("name_b"))
    linked = a.join(b, "person").filter(F.encode("name_a", "UTF-8") < F.encode("name_b", "UTF-8")).select("name_a", "name_b")
    return linked.unionByName(apart).distinct()


def _unmet(nodes: DataFrame, agreed: DataFrame, least: float) -> DataFrame:
    """Spellings that agree with none of their neighbours but with any other spelling of their
    person, each compared with all of them."""
    left = nodes.join(agreed, ["spelling", "person"], "left_anti").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    others = nodes.select("person", F.col("spelling").alias("other"), F.pmod(F.xxhash64("spelling"), F.lit(PARTS)).cast("int").alias("part"))
    pairs = left.join(others, ["person", "part"]).filter("spelling <> other").select("spelling", "person", "other")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [ratio(" ".join(sorted(words_of(s))), " ".join(sorted(words_of(o)))) >= least for s, o in zip(f["spelling"], f["other"])]
            yield f.loc[keep, ["spelling", "person"]]

    return pairs.mapInPandas(compare, "spelling string, person string")
