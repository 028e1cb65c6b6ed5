"""Personal values in free text, and texts with typed placeholders in their place.

Bootstrapped contextual extraction. Seeds are full names from structured headers and the
labels that announce identity numbers. Spark builds graphs of patterns (the word before a
capitalised word; label and shape of a number; the words after a street) and the instances
they occur with, and scores them in turns: patterns by the share of their instances that
are accepted, instances by the share of their occurrences under accepted patterns. Accepted
patterns find people and numbers that no seed has named. A last pass over every text applies
the accepted patterns and the fixed shapes of addresses and telephone numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.packed import address_of, clean_name
from ..session import written

KINDS = ("email", "phone", "id_number", "street_address", "name")
#: Rounds of scoring; accepted share of a pattern's instances and of an instance's occurrences; least support,
#: and uses of a pattern with one instance only.
ROUNDS, PATTERN_SHARE, INSTANCE_SHARE, SUPPORT, SOLE = 2, 0.6, 0.5, 2, 3
#: Accepted surnames that are broadcast at most (about 30 bytes each); beyond it they are joined to the texts by shuffle.
LEXICON_LIMIT = 300_000
#: Words that announce identity numbers, and words that announce other numbers (fixed values).
ID_LABELS = frozenset({"ssn", "ss#", "security number", "passport", "passport no", "passport number", "badge", "badge no", "employee id", "employee no", "employee number", "staff no", "staff id", "licence", "license", "licence no", "license no", "dl no", "dl", "tax id", "tax number", "tax no", "itin", "tin"})
OTHER_LABELS = frozenset({"part no", "part number", "purchase order", "order", "ticket", "invoice", "meter", "permit", "deal", "build", "case", "zone", "unit", "room", "no", "lot", "schedule", "check", "outage", "rollout", "version", "job", "label", "change"})
_TITLES = frozenset({"mr", "mrs", "ms", "dr", "prof", "sir", "the", "and", "of", "to", "by", "with", "for", "from", "in", "on", "at", "has", "is", "a", "saint", "port", "san", "st"})

#: A line break may carry the marks of quoted mail.
_SP = r"(?:[^\S\n]|[^\S\n]?\n(?:>+[^\S\n]?)*|\s>+\s)+"
_SP0 = _SP[:-1] + "*"
_LOCAL = re.compile(r"(?<![\w.+@/-])[\w.+'-]*\w\Z")
_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{{dot\}})\s?|{_SP}(?:dot|DOT){_SP})[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*)+(?![\w@-])")
_AT = re.compile(rf"@|\s?(?:\(at\)|\[at\]|\{{at\}}|<at>)\s?|{_SP}(?:at|AT){_SP}(?=[\w-]+{_SP}(?:dot|DOT){_SP})")
#: Whether a text may hold an address without @.
_DISGUISED = re.compile(r"[(\[{<]at[)\]}>]|\s(?:dot|DOT)\s")
_EXT = rf"(?:{_SP0}(?:ext\.?|x|extension){_SP0}\d{{1,6}}\b)?"
_PHONE = re.compile(
    rf"""(?<![\w.@/+\-#$])(?:
      \+\d{{1,3}}{_SP0}(?:\(0\){_SP0})?\d{{2,4}}(?:(?:{_SP}|[/.-])\d{{2,5}}){{1,4}}
    | \+\d{{10,14}}
    | (?:1[-. ])?\(\d{{3}}\){_SP0}\d{{3}}[-. ]\d{{4}}
    | \+?1[-. ]\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}
    | \d{{3}}[/.-]\d{{3}}[.-]\d{{4}}
    | \d{{3}}{_SP}\d{{3}}{_SP}\d{{4}}
    | 0\d{{2,4}}{_SP}\d{{3,4}}{_SP}\d{{4}}
    | \d{{10}}
    | \d{{3}}-\d{{4}}
    ){_EXT}(?![\w@]|[-/]\w|\.\d)""",
    re.X,
)
_NUMBER = re.compile(r"(?<![\w.@/+-])(?:[A-Z]{1,4}-?\d[\d-]{3,}(?:-[A-Z])?|\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}|\d\d-\d{3}-\d{3}-[A-Z]|\d{9})(?![\w@]|-\w)")
#: Runs of figures in which the two patterns above are tried, at the start of each group only.
_RUN = re.compile(r"[+(\d][\d()\s>./+-]{6,}")
_FIGURES = re.compile(r"\d[\d -]{3,}")
_SUFFIX = r"(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Way|Blvd|Boulevard|Parkway|Pkwy|Place|Pl|Terrace|Ter|Circle|Cir|Square|Sq|Trail|Trl|Highway|Hwy|Row|Close|Crescent|Alley|Plaza|Loop)"
_STREET = re.compile(
    rf"(?<![\w.,$#/@-])(?:\d{{1,5}}[A-Z]?{_SP}(?:[NSEW]\.?{_SP})?(?:(?!{_SUFFIX}\b)[A-Z][\w'’é-]*{_SP}){{1,4}}{_SUFFIX}\b\.?|(?:P\.{_SP0}O\.|PO|Post{_SP}Office){_SP}Box{_SP}\d+)"
    rf"(?:,?{_SP}(?:(?:Apt|Apartment|Suite|Ste|Unit|Room|Floor|Fl)\.?{_SP}\w+|\#{_SP0}\w+)\b)?"
)
_CITY = r"[A-Z][\w'’é-]*(?:{sp}[A-Z][\w'’é-]*){{0,2}}?".format(sp=_SP)
_STATE = re.compile(rf",?{_SP}({_CITY}),?{_SP}([A-Z]{{2}}){_SP}(\d{{5}}(?:-\d{{4}})?)(?![\w-])")
_CITY_ALONE = re.compile(rf",{_SP}({_CITY.replace('{0,2}?', '{0,2}')})(?:,?{_SP}([A-Z]{{2}})\b)?")
_AROUND = ".,;:!?()[]{}<>\"'|*_-/\\"
_LABELS_AFTER = re.compile(r"\s*(?:$|(?:Tel|Phone|Direct|Fax|Cell|Mobile|E-?mail)\b|[+(\d|]|mailto:|\n)")


def squeeze(value: str) -> str:
    """A value as written, white space runs (and quotation marks in them) as one space."""
    return re.sub(r"\s+(?:>+\s+)*", " ", value).strip()


def label_before(text: str, at: int) -> str:
    """The label before a number: its last two words in lower case without punctuation, or the
    bracket or sign that stands directly before it."""
    before = re.sub(r"[\s>]+", " ", text[max(0, at - 40) : at]).rstrip()
    if before.endswith(("(", "[", "=")):
        return before[-1]
    words = [w.strip(".:;,\"'") for w in before.split()[-2:]]
    return " ".join(w.lower() for w in words if w)


def is_label(label: str, labels: Iterable[str]) -> bool:
    return label in labels or label.split(" ")[-1] in labels


def phones_in(text: str) -> Iterator[re.Match]:
    for run in _RUN.finditer(text):
        at, end = run.span()
        while at < end:
            c = text[at]
            if (c.isdigit() and not text[at - 1 : at].isdigit()) or c in "+(":
                if m := _PHONE.match(text, at):
                    yield m
                    at = m.end()
                    continue
            at += 1


def numbers_in(text: str) -> Iterator[re.Match]:
    for run in _FIGURES.finditer(text):
        at, end = run.span()
        while at < end:
            if text[at].isdigit() and not text[at - 1 : at].isdigit():
                first = at
                if first and text[first - 1] == "-":
                    first -= 1
                while at - first < 6 and first and "A" <= text[first - 1] <= "Z":
                    first -= 1
                if m := (_NUMBER.match(text, first) or (_NUMBER.match(text, at) if first < at else None)):
                    yield m
                    at = max(m.end(), at + 1)
                    continue
            at += 1


def shape_of(value: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", value))


@dataclass
class Patterns:
    """What the scoring accepted."""

    given: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    labels: frozenset[tuple[str, str]] = frozenset()  # (label, shape) of identity numbers
    cities: frozenset[str] = frozenset()
    #: (given, surname) of people whose surname is more often a first name: no other first name makes it a surname
    dual: frozenset[tuple[str, str]] = frozenset()


@lru_cache(maxsize=2)
def _deletions(given: frozenset[str]) -> tuple[frozenset[str], frozenset[tuple[int, str]]]:
    """The longer names with one letter after the first left out: the words that remain, and the same with the letter's place."""
    places = frozenset((i, g[:i] + g[i + 1 :]) for g in given if len(g) > 4 for i in range(1, len(g)))
    return frozenset(w for _, w in places), places


class Finder:
    """Finds the values of one text with accepted patterns."""

    def __init__(self, patterns: Patterns, surnames: frozenset[str] | None = None):
        import ahocorasick

        self.p = patterns
        self.surnames = patterns.surnames if surnames is None else surnames
        self.slips: dict[str, bool] = {}
        self.dual: dict[str, set[str]] = {}
        for g, s in patterns.dual:
            self.dual.setdefault(s, set()).add(g)
        self.automaton = ahocorasick.Automaton()
        for s in (*self.surnames, *self.dual):
            self.automaton.add_word(s, len(s))
        self.automaton.make_automaton()

    def emails(self, text: str) -> Iterator[tuple[int, int]]:
        if _DISGUISED.search(text):
            marks = [m.span() for m in _AT.finditer(text)]
        else:
            marks, at = [], text.find("@")
            while at >= 0:
                marks.append((at, at + 1))
                at = text.find("@", at + 1)
        for a, b in marks:
            if (right := _DOMAIN.match(text, b)) and (left := _LOCAL.search(text, max(0, a - 65), a)):
                yield left.start(), right.end()

    def phones(self, text: str) -> Iterator[tuple[int, int]]:
        for m in phones_in(text):
            label = label_before(text, m.start())
            if not is_label(label, OTHER_LABELS) or label.endswith((" no", "call")) and "part" not in label and "order" not in label:
                yield m.span()

    def numbers(self, text: str) -> Iterator[tuple[int, int]]:
        for m in numbers_in(text):
            label = label_before(text, m.start())
            if is_label(label, ID_LABELS) or (label, shape_of(m.group())) in self.p.labels or (label.split(" ")[-1], shape_of(m.group())) in self.p.labels:
                yield m.span()

    def streets(self, text: str) -> Iterator[tuple[int, int]]:
        for m in _STREET.finditer(text):
            a, b = m.span()
            if rest := _STATE.match(text, b):
                b = rest.end()
            elif (rest := _CITY_ALONE.match(text, b)) and (city := self._city(rest.group(1))):
                b = rest.start(1) + city
                if rest.group(2) and city == len(rest.group(1)):
                    b = rest.end()
            elif text[b - 1] == "." and not re.match(r"\s+[a-z0-9#(]", text[b : b + 4]) and not _LABELS_AFTER.match(text, b):
                b -= 1
            yield a, b

    def _city(self, words: str) -> int:
        """Length of the longest known city at the start."""
        parts = list(re.finditer(r"\S+", words))
        for k in range(len(parts), 0, -1):
            if squeeze(words[: parts[k - 1].end()]).lower() in self.p.cities:
                return parts[k - 1].end()
        return 0

    def names(self, text: str) -> list[tuple[int, int]]:
        if not len(self.automaton):
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found: list[tuple[int, int]] = []
        for end, size in self.automaton.iter(low):
            a, b = end - size + 1, end + 1
            if (a and (low[a - 1].isalnum() or low[a - 1] in "_@.'’-")) or (b < len(low) and (low[b].isalnum() or low[b] in "_@" or (low[b] in ".-'’" and b + 1 < len(low) and low[b + 1].isalnum() and low[b : b + 2] != "'s"))):
                continue
            span = self._around(text, low, a, b)
            if span and low[a:b] in self.dual and not self._meant(low[span[0] : span[1]], low[a:b]):
                continue
            if span and (not found or span[0] >= found[-1][1]):
                found.append(span)
        return found

    def _meant(self, name: str, surname: str) -> bool:
        """Whether a name with a surname that is mostly a first name is known as a whole, its first name or initial allowed."""
        words = re.findall(r"[^\W\d_][\w'’-]*", name)
        words.remove(surname)
        return any(g == w or (len(w) == 1 and g[0] == w) for g in self.dual[surname] for w in words)

    def _around(self, text: str, low: str, a: int, b: int) -> tuple[int, int] | None:
        """The full name around the surname text[a:b], if it has a given name or initials."""
        left = _LEFT.search(text, max(0, a - 48), a)
        if left:
            given, initials = left.group("given"), left.group("mid")
            if (given.lower() in self.p.given or self._slip(given)) and not (given.islower() != text[a:b].islower()):
                return left.start("given"), b
            if initials and not given.lower() in self.p.given:
                left = None  # the initials alone are looked at next
        alone = _INITIALS.search(text, max(0, a - 12), a)
        if alone and text[a].isupper():
            value = alone.group("i")
            if not (value in ("N.", "S.", "E.", "W.", "I", "A") and not value.endswith(".")) and value.upper() == value:
                return alone.start("i"), b
        right = _COMMA.match(text, b)
        if right:
            given = right.group("given")
            if given.rstrip(".").lower() in self.p.given:
                mid = right.group("mid") or ""
                return a, (right.end("mid") if mid else right.end("given") - (1 if given.endswith(".") and len(given) > 2 else 0))
            if re.fullmatch(r"[A-Z]\.?(?:\s?[A-Z]\.?)?", given) and text[a].isupper():
                return a, right.end("given")
        behind = _BEHIND.match(text, b)
        if behind and behind.group("given").lower() in self.p.given and text[a].isupper() == behind.group("given")[0].isupper():
            # surname first: not where the given name opens the next full name
            after = _NEXT.match(text, behind.end())
            if not (after and after.group(1).lower() in self.surnames):
                mid = behind.group("mid") or ""
                return a, behind.end("mid") if mid else behind.end("given")
        return None

    def _slip(self, word: str) -> bool:
        """Whether a capitalised word is an accepted given name with two letters exchanged, one dropped, doubled or changed."""
        if word not in self.slips:
            w = word.lower()
            shorter, places = _deletions(self.p.given)
            self.slips[word] = word[0].isupper() and len(w) > 4 and w not in _TITLES and (
                any(w[:i] + w[i + 1] + w[i] + w[i + 2 :] in self.p.given or w[:i] + w[i + 1 :] in self.p.given for i in range(1, len(w) - 1))
                or w in shorter or any((i, w[:i] + w[i + 1 :]) in places for i in range(1, len(w)))
            )
        return self.slips[word]

    def values(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) without overlaps, in order; earlier kinds of KINDS win."""
        taken: list[tuple[int, int, str]] = []
        marks = bytearray(len(text))
        for kind, spans in (("email", self.emails(text)), ("id_number", self.numbers(text)), ("street_address", self.streets(text)), ("phone", self.phones(text)), ("name", self.names(text))):
            for a, b in spans:
                if not any(marks[a:b]):
                    marks[a:b] = b"\x01" * (b - a)
                    taken.append((a, b, kind))
        return sorted(taken)


_LEFT = re.compile(rf"(?<![\w'’@.\-])(?P<given>[^\W\d_][\w'’-]+)(?P<mid>(?:{_SP}[A-Za-z]\.?(?:{_SP0}[A-Z]\.)?)?){_SP}\Z")
_INITIALS = re.compile(rf"(?<![\w'’@.\-/])(?P<i>[A-Z]\.(?:{_SP0}[A-Z]\.)?|[A-Z]{{1,2}}|[A-Z]{_SP}[A-Z]){_SP}\Z")
_COMMA = re.compile(rf",{_SP0}(?P<given>[^\W\d_][\w'’-]+\.?|[A-Z]\.(?:{_SP0}[A-Z]\.)?|[A-Z](?![\w'’]))(?P<mid>(?:{_SP}[A-Z](?:\.|(?![\w'’.-])))?)(?!\w)")
_BEHIND = re.compile(rf"{_SP}(?P<given>[^\W\d_][\w'’-]+)(?P<mid>(?:{_SP}[A-Z](?:\.|(?![\w'’.-])))?)(?![\w@])")
_NEXT = re.compile(rf"(?:{_SP}[A-Z]\.?)?{_SP}([^\W\d_][\w'’-]+)")


# -- bootstrapping

#: Beginnings of addresses that belong to firms (fixed values).
_ROLE = re.compile(r"(?:info|billing|notices|office|contact|sales|admin|support)(?:[._-]|\Z)")


def header_names(value: str | list[str] | None) -> list[tuple[str, str, bool]]:
    """(given, surname, sure) in lower case, as a header entry states them: "Last, First", the
    address first.last, and "First Last" beside an address or path, which is not sure as it may
    be "Last First" without its comma. Two capitals are initials, no first name."""
    out = []
    for entry in value if isinstance(value, list) else [value]:
        if not entry:
            continue
        local = address_of(entry).split("@")[0].lower()
        name = re.sub(r"\([^)]*\)", "", clean_name(entry)).strip() if "@" not in re.split("[<>/]", entry)[0] else ""
        if re.match(_ROLE, local) or re.search(r"\b(?:Inc|Co|Corp|LLC|Ltd|Company|Corporation|Group|Grp|Bank|Bk|Offices|Services|Energy|Pipeline)\b", name):
            continue
        if m := re.fullmatch(r"([^\W\d_][\w'’-]{2,}), (?![A-Z]{2}\b)([^\W\d_][\w'’-]{1,})(?: [A-Z]\.?)?", name):
            out.append((m.group(2).lower(), m.group(1).lower(), True))
        elif (m := re.fullmatch(r"(?![A-Z]{2}\b)([^\W\d_][\w'’-]{1,})(?: [A-Z]\.?)? ([^\W\d_][\w'’-]{2,})", name)) and ("/" in entry or "<" in entry):
            out.append((m.group(1).lower(), m.group(2).lower(), False))
        elif not name and (m := re.fullmatch(r"([a-z]{3,})[._]([a-z]{3,})", local)):
            out.append((m.group(1), m.group(2), True))
    return out


def seed_pairs(headers: DataFrame, columns: list[str]) -> DataFrame:
    """(given, surname, n) from structured headers, counted by batch and then by Spark.

    A pair that is not sure is turned where its second word is more of a first name than its
    first by the sure pairs: by the share of those a word is the first name of, smoothed by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter[tuple[str, str, bool]] = Counter()
            for column in batch.columns:
                uses = Counter(e for v in column.to_pylist() for e in (v if isinstance(v, list) else (v,)))
                for value, n in uses.items():
                    for pair in header_names(value):
                        count[pair] += n
            columns = [pa.array([k[i] for k in count], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(count.values()), pa.int64())], names=["given", "surname", "sure", "n"])

    pairs = headers.select(*columns).mapInArrow(run, "given string, surname string, sure boolean, n bigint").groupBy("given", "surname", "sure").agg(F.sum("n").alias("n"))
    pairs = written(pairs, "pairs")
    uses = pairs.filter("sure").select(F.explode(F.array(F.struct(F.col("given").alias("word"), F.lit(1).alias("opens")), F.struct(F.col("surname").alias("word"), F.lit(0).alias("opens")))).alias("u"))
    share = uses.groupBy("u.word").agg(((F.sum("u.opens") + 0.5) / (F.count("*") + 1)).alias("share"))
    unsure = pairs.filter("not sure").join(share.withColumnsRenamed({"word": "given", "share": "a"}), "given", "left").join(share.withColumnsRenamed({"word": "surname", "share": "b"}), "surname", "left")
    turn = F.coalesce("b", F.lit(0.5)) > F.coalesce("a", F.lit(0.5))
    first, last = F.when(turn, F.col("surname")).otherwise(F.col("given")), F.when(turn, F.col("given")).otherwise(F.col("surname"))
    return unsure.select(first.alias("given"), last.alias("surname"), "n").unionByName(pairs.filter("sure").drop("sure")).groupBy("given", "surname").agg(F.sum("n").alias("n"))


def evidence(texts: DataFrame, text: str) -> DataFrame:
    """(graph, pattern, instance, n): every edge of the three graphs, counted by batch and then
    by Spark. name: capitalised word ("^" for any other) before a capitalised word; id: label
    and shape; city: words after a street with a state or without. The rows of graph "low" count
    every word's uses in small letters; their pattern is empty."""

    def edges(t: str) -> Iterator[tuple[str, str, str]]:
        left = ""
        for w in t.split():
            if w[0].isupper() or not w[0].isalnum():
                word = w.strip(_AROUND)
                if len(word) > 2 and word[0].isupper() and word.replace("-", "").replace("'", "").isalpha():
                    # only blanks may stand between a first name and a surname, or an initial's period
                    bare = left.lstrip(_AROUND)
                    near = w[0].isupper() and (bare.isalpha() or (len(bare) == 2 and bare[1] == "."))
                    yield "name", "^" if not near or not bare[0].isupper() else "initial" if len(bare) < 3 and not bare[1:].islower() else bare.lower(), word.lower()
            if w.strip(">"):
                left = w
        for m in numbers_in(t):
            yield "id", label_before(t, m.start()), shape_of(m.group())
        for m in _STREET.finditer(t):
            if rest := _STATE.match(t, m.end()):
                yield "city", "state", squeeze(rest.group(1)).lower()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter[tuple[str, str, str]] = Counter()
            used: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    count.update(edges(t))
                    used.update(t.split())
            for w, n in used.items():
                if w.islower() and (bare := w.strip(_AROUND)).isalpha() and len(bare) > 2:
                    count["low", "", bare] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in count], pa.string()) for i in range(3)] + [pa.array(list(count.values()), pa.int64())], names=["graph", "pattern", "instance", "n"])

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "graph string, pattern string, instance string, n bigint").groupBy("graph", "pattern", "instance").agg(F.sum("n").alias("n"))


def bootstrap(graph: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(given: word, surnames: word, dual: given, surname): patterns and instances of the name
    graph after scoring, and the seeds whose surname is more often a first name.

    Words more often written in small letters than as a name are words of the language; they
    count for nothing unless a seed. The accepted words start as the seeds'. In every round a
    capitalised word before others is accepted as a given name if PATTERN_SHARE of its different
    instances are accepted surnames and SUPPORT of them are (or its only instance is one, SOLE
    times), and a capitalised word as a surname if INSTANCE_SHARE of its occurrences stand behind
    accepted given names or initials, one at least behind a given name.
    """
    seeds = written(seeds, "seeds")
    # two sums over one shuffle: uses of each word in small letters against its uses as a capitalised word
    plain = graph.filter("graph in ('name', 'low')").groupBy("instance").agg(F.sum(F.when(F.col("graph") == "low", F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("graph") == "name", F.col("n")).otherwise(0)).alias("cap")).filter("low > cap").select(F.col("instance").alias("word"))
    plain = written(plain, "plain")
    name = written(graph.filter("graph = 'name'").join(plain.withColumnRenamed("word", "instance"), "instance", "left_anti"), "names")
    strong = seeds.groupBy("given").agg(F.countDistinct("surname").alias("k"), F.sum("n").alias("n")).filter((F.col("k") >= 3) | (F.col("n") >= 5)).select(F.col("given").alias("word"))
    given = strong
    first = seeds.groupBy(F.col("given").alias("word")).agg(F.sum("n").alias("g"))
    last = seeds.groupBy(F.col("surname").alias("word")).agg(F.sum("n").alias("s"))
    mostly_given = first.join(last, "word").filter("g > s").select("word")
    held = seeds.filter(F.length("surname") > 2).join(strong.withColumnRenamed("word", "given"), "given", "left_semi")
    dual = held.join(mostly_given.withColumnRenamed("word", "surname"), "surname", "left_semi").select("given", "surname").distinct()
    surnames = held.select(F.col("surname").alias("word")).distinct().join(mostly_given, "word", "left_anti")
    for k in range(rounds):
        known = surnames.withColumn("is_surname", F.lit(1))
        scored = (
            name.filter(~F.col("pattern").isin("^", "initial", *_TITLES)).join(given.withColumnRenamed("word", "instance"), "instance", "left_anti").join(known, F.col("instance") == F.col("word"), "left")
            .groupBy("pattern").agg(F.count("*").alias("all"), F.sum("n").alias("n"), F.sum(F.coalesce("is_surname", F.lit(0))).alias("hits"))
        )
        enough = (F.col("hits") >= SUPPORT) | ((F.col("hits") == F.col("all")) & (F.col("n") >= SOLE))
        fresh = scored.filter(enough & (F.col("hits") >= PATTERN_SHARE * F.col("all"))).select(F.col("pattern").alias("word")).join(surnames, "word", "left_anti").join(plain, "word", "left_anti")
        given = written(given.unionByName(fresh).distinct(), f"given{k}")
        marked = name.join(given.withColumn("is_given", F.lit(1)), F.col("pattern") == F.col("word"), "left")
        by = (
            marked.groupBy("instance")
            .agg(F.sum("n").alias("all"), F.sum(F.when(F.col("is_given").isNotNull(), F.col("n")).otherwise(0)).alias("behind"), F.sum(F.when(F.col("is_given").isNotNull() | (F.col("pattern") == "initial"), F.col("n")).otherwise(0)).alias("hits"))
            .filter((F.col("behind") > 0) & (F.col("hits") >= INSTANCE_SHARE * F.col("all")))
        )
        more = by.select(F.col("instance").alias("word")).join(given, "word", "left_anti")
        surnames = written(surnames.unionByName(more).distinct(), f"surnames{k}")
    return given, surnames, dual


def id_labels(graph: DataFrame) -> list[tuple[str, str]]:
    """(label, shape) pairs that announce identity numbers though no seed label is in them.

    A shape's strength is the share of its occurrences under seed labels among those whose
    label is a seed or a new one; labels of other numbers never pass. Shapes are few (digits
    and letters of short numbers); labels are aggregated before anything is collected.
    """
    ids = graph.filter("graph = 'id'").withColumn("last", F.element_at(F.split("pattern", " "), -1))
    seed = F.col("pattern").isin(*ID_LABELS) | F.col("last").isin(*ID_LABELS)
    other = F.col("pattern").isin(*OTHER_LABELS) | F.col("last").isin(*OTHER_LABELS)
    shapes = ids.groupBy("instance").agg(F.sum(F.when(seed, F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(other, 0).otherwise(F.col("n"))).alias("all"))
    strong = shapes.filter((F.col("hits") >= SUPPORT) & (F.col("hits") >= 0.5 * F.col("all"))).select("instance")
    rows = ids.filter(~seed & ~other).join(strong, "instance", "left_semi").groupBy("last", "instance").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT).collect()
    return [(r["last"], r.instance) for r in rows]


def learn(texts: DataFrame, text: str, seeds: DataFrame, limit: int = LEXICON_LIMIT) -> tuple[Patterns, DataFrame | None]:
    """Accepted patterns; and the surnames as a table, if there are more than `limit`."""
    graph = written(evidence(texts, text), "graph")
    given, surnames, dual = bootstrap(graph, seeds)
    few = surnames.limit(limit + 1).count() <= limit
    # given names are patterns with many surnames: their number is bounded by the distinct first names of the world; all are kept, as are all cities
    names = frozenset(r.word for r in given.collect())
    cities = frozenset(r.instance for r in graph.filter("graph = 'city' and n >= 2").select("instance").distinct().collect())
    patterns = Patterns(names, frozenset(r.word for r in surnames.collect()) if few else frozenset(), frozenset(id_labels(graph)), cities, frozenset((r.given, r.surname) for r in dual.collect()))
    return patterns, None if few else surnames


def _with_surnames(texts: DataFrame, key: str, text: str, surnames: DataFrame | None) -> DataFrame:
    """Adds `known`, the accepted surnames in a text, found by join where they are too many to broadcast."""
    if surnames is None:
        return texts.withColumn("known", F.lit(None).cast("array<string>"))
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}][\p{L}\p{N}'’-]+)"), 1)

    def beginnings(token: Column) -> Column:
        # up to every mark, as a surname may stand before a possessive or a trailing mark; the finder decides which do
        parts = F.split(token, "(?<=['’-])")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n), ""), "['’-]+$", ""))

    words = texts.select(key, F.explode(F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, beginnings))))).alias("word"))
    known = words.join(surnames, "word").groupBy(key).agg(F.collect_set("word").alias("known"))
    return texts.join(known, key, "left")


def find_values(texts: DataFrame, key: str, text: str, patterns: Patterns, surnames: DataFrame | None = None) -> DataFrame:
    """(key, start, kind, val): every personal value; start counts characters from 0.

    Null and empty texts give no rows; a value that occurs twice gives two rows; repeated
    rows give repeated rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(patterns)
        for batch in batches:
            take, start, kinds, vals = [], [], [], []
            for i, (t, known) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not t:
                    continue
                own = Finder(patterns, frozenset(known)) if known is not None else finder
                for a, b, kind in own.values(t):
                    take.append(i)
                    start.append(a)
                    kinds.append(kind)
                    vals.append(squeeze(t[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(start, pa.int64()), pa.array(kinds, pa.string()), pa.array(vals, pa.string())], names=[key, "start", "kind", "val"])

    rows = _with_surnames(texts.select(F.col(key), F.col(text).cast("string").alias("__t")), key, "__t", surnames)
    return rows.select(key, "__t", "known").mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, start bigint, kind string, val string")


def redact(texts: DataFrame, key: str, text: str, patterns: Patterns, surnames: DataFrame | None = None) -> DataFrame:
    """(key, redacted): every text with each personal value replaced by [EMAIL], [PHONE],
    [ID_NUMBER], [STREET_ADDRESS] or [NAME]; everything else is kept as it is. A null text
    stays null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(patterns)
        for f in frames:
            out = []
            for t, known in zip(f["__t"], f["known"]):
                if not isinstance(t, str):
                    out.append(None)
                    continue
                own = Finder(patterns, frozenset(known)) if known is not None else finder
                parts, at = [], 0
                for a, b, kind in own.values(t):
                    parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                out.append("".join([*parts, t[at:]]))
            yield pd.DataFrame({key: f[key], "redacted": out})

    rows = _with_surnames(texts.select(F.col(key), F.col(text).cast("string").alias("__t")), key, "__t", surnames)
    return rows.select(key, "__t", "known").mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, redacted string")
