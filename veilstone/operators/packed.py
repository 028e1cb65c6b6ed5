"""Several values packed into one field: one row per value, with its position.

Dictionary-guided segmentation. A field's known whole values (bare addresses, angle-bracket
entries, quoted names, known personal names) are found in one pass of a multi-pattern
automaton and of the grammar of self-delimiting values; dynamic programming then picks the
cover of the field that explains it best, so a delimiter inside a known value ("Last,
First", "Last; First (HOU)") never splits it.

The names of the dictionary come from the table itself: every name standing beside an
address or a directory path is known. The dictionary is counted before it is broadcast;
beyond its limit the values that the cover of each field could take from the dictionary are
joined to the names instead, and each field is segmented with the names found in it, which
gives the same values.
"""

from __future__ import annotations

import bisect
import copy
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Known names that are broadcast at most (about 450 bytes each with the automaton's nodes, so 90 MB in a worker).
DICTIONARY_LIMIT = 200_000
#: Characters of a name of the dictionary at most: 60, which lower case can double.
LONGEST = 120
#: Rows that are taken apart at once, and values that are given at once beyond one row's own.
SLICE, VALUES = 1000, 20_000
_ADDRESS = r"[\w.+&=%'’-]*\w@[\w-]+(?:\.[\w-]+)+"
_ONE = re.compile(
    rf"""
    (?P<angle>(?:"(?P<quoted>[^"<>]*)"|'(?P<single>[^'"<>@]*)'|(?P<plain>[^"<>;|\t\n@]*+(?:@\ ?[A-Z][A-Z]++[^"<>;|\t\n@]*+)?|{_ADDRESS}\ *))\ *<(?:mailto:|SMTP:)?(?P<inner>[^<>]*)>)
  | (?P<path>(?P<pathname>[^\s"'<>;|,/@][^"<>;|,/@\t\n]*)/[\w&. -]+(?:/[\w&. -]+)*(?:@[\w&.-]+)?)
  | (?P<bare>["']?(?:(?i:mailto|SMTP):)?(?P<address>{_ADDRESS})["']?(?:\s*\((?P<remark>[^()]*)\))?)
  | (?P<q2>"(?P<name2>[^"]*)")
  | (?P<q3>(?<![\w])'(?P<name3>[^']*(?:'\w[^']*)*)'(?!\w))
    """,
    re.X,
)
_EMPTY = re.compile(r"(?i)\W*(?:undisclosed|unlisted)[ -]*recipients?\W*\Z")


def clean_name(name: str | None) -> str:
    """A name as written: without outer quotes and anything from an angle bracket or slash on."""
    if not name:
        return ""
    name = re.split(r"[<>/]", name, maxsplit=1)[0]
    name = re.sub(r"\s+", " ", name).strip(" \t,;|")
    while len(name) > 1 and name[0] in "\"'" and name[-1] == name[0]:
        name = name[1:-1].strip()
    return name.strip("\"").strip(" ,;|").strip()


def address_of(text: str) -> str:
    """The bare address in a text, in lower case, or ''."""
    found = re.search(_ADDRESS, text)
    return found.group().strip("'\"").lower() if found else ""


def is_name(text: str) -> bool:
    """Whether a cleaned text can name somebody: it has letters and is no address or empty list."""
    return bool(re.search(r"[^\W\d_]", text)) and not re.search(r"\S@|@\S", text) and not _EMPTY.match(text)


class Segmenter:
    """Cuts one header string into (name, address) entries.

    commas: whether a comma can divide entries (typed headers) or only belongs to names
    (address lists that were cut at commas and joined again).
    """

    def __init__(self, known: list[str], commas: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for name in known:
            self.automaton.add_word(name.lower(), len(name))
        self.known = len(known)
        if known:
            self.automaton.make_automaton()
        self.commas = commas

    def for_lists(self) -> Segmenter:
        """The same names for address lists, in the same automaton."""
        other = copy.copy(self)
        other.commas = False
        return other

    def names_in(self, text: str) -> list[tuple[int, int]]:
        """Spans of known names that stand between delimiters or line ends."""
        if not self.known:
            return []
        low = text.lower()
        if len(low) != len(text):
            return []
        out = []
        for end, size in self.automaton.iter(low):
            a, b = end - size + 1, end + 1
            if re.match(r"[\s,;|'\"<(/]|\Z", low[b : b + 1]) and (a == 0 or re.match(r"[\s,;|'\">]", low[a - 1])):
                out.append((a, b))
        return out

    def split_plain(self, text: str) -> list[str]:
        """The values of a run without brackets: the cover of least cost, where a known name
        costs least, then a full name (two parts or "Last, First"), then anything else."""
        text = text.strip(" \t\n")
        if not text.strip(" ,;|"):
            return []
        hard = [m.start() for m in re.finditer(r"[;|\t\n]", text)]
        if hard:
            known = [(a, b) for a, b in self.names_in(text) if any(a < h < b for h in hard)]
            out, at = [], 0
            for h in [*hard, len(text)]:
                if h < at or any(a < h < b for a, b in known):
                    continue
                if not at and h == len(text):  # every delimiter belongs to a known name
                    return [text.strip(" ,")]
                out += self.split_plain(text[at:h])
                at = h + 1
            return out
        if not self.commas or "," not in text:
            return [text.strip(" ,")]
        edges = [-1, *(m.start() for m in re.finditer(",", text)), len(text)]
        parts = [text[i + 1 : j].strip() for i, j in zip(edges, edges[1:])]
        n = len(parts)
        known = {text[a:b].lower() for a, b in self.names_in(text)}
        most = max(3, *(name.count(",") + 1 for name in known)) if known else 3
        best: list[tuple[float, int]] = [(0.0, 0)] + [(1e9, 0)] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - most), j):
                if j - i > 1 and not all(parts[i:j]):
                    continue
                value = ", ".join(parts[i:j])
                if j - i > 3 and value.lower() not in known:
                    continue
                cost = best[i][0] + self.cost(value, j - i, known)
                if cost < best[j][0]:
                    best[j] = (cost, i)
        out, j = [], n
        while j:
            i = best[j][1]
            if value := text[edges[i] + 1 : edges[j]].strip(" ,"):
                out.append(value)
            j = i
        return out[::-1]

    @staticmethod
    def cost(value: str, parts: int, known: set[str]) -> float:
        if not value:
            return 0.0
        if value.lower() in known:
            return 0.5
        words = value.replace(",", " ").split()
        firm = re.search(r"(?i)(?:^|[ ,])(?:Inc|LLC|L\.L\.C|Ltd|LP|L\.P|Corp|Co|Company|Corporation|Group|Grp|Bank|LLP|PLC|GmbH|Offices|Services)\.?$", value)
        if parts == 1:
            return 1.2 if len(words) > 1 else 2.6
        if parts == 2:
            left, right = value.split(", ", 1)
            if re.fullmatch(r"(?i)(?:Inc|LLC|L\.L\.C|Ltd|LP|L\.P|Corp|Co|LLP|PLC|Jr|Sr|II|III|IV|Esq|P\.C|N\.A)\.?(?: \(.*\))?", right):
                return 1.1
            if firm:
                return 4.0
            lefts, rights = left.split(), re.sub(r"\([^)]*\)", "", right).split()
            if len(lefts) == 1 and 1 <= len(rights) <= 2:
                return 1.5 if len(rights) == 1 or len(rights[1].strip(".")) == 1 or len(rights[0].strip(".")) == 1 else 2.2
            if len(lefts) == 2 and len(rights) == 1 and lefts[0].lower() in {"van", "von", "de", "la", "le", "du", "di", "mc", "st."}:
                return 1.6
            return 4.5
        left, right, more = value.split(", ", 2)
        return 1.4 if re.fullmatch(r"(?i)(?:Jr|Sr|II|III|IV|Esq)\.?", right) and " " not in left else 9.0

    def entries(self, text: str | None) -> list[tuple[str, str]]:
        """(name, address) of every entry, in order; either may be ''."""
        if not text or not text.strip() or _EMPTY.match(text):
            return []
        out: list[tuple[str, str]] = []
        at = 0
        for m in _ONE.finditer(text):
            if m.end() <= at or m.start() < at:
                continue
            gap = text[at : m.start()]
            if m.group("angle") is not None:
                if m.group("plain") is not None:
                    # unquoted text before a bracket: its last value belongs to the bracket
                    values = self.split_plain(gap + m.group("plain"))
                    before, name = values[:-1], values[-1] if values else ""
                    if re.search(r"[;|\t\n,]\s*\Z", gap + m.group("plain")):
                        before, name = values, ""
                    if " " in name and "@" in name:
                        more = re.findall(_ADDRESS, name)
                        before, name = [*before, *more[:-1]], more[-1] if more else ""
                else:
                    before, name = self.split_plain(gap), m.group("quoted") if m.group("quoted") is not None else m.group("single")
                out += [self.entry(v, "") for v in before]
                address = address_of(m.group("inner") or "")
                shown = address_of(name or "")
                if shown and address and shown != address and m.group("plain") is not None:
                    out.append(("", shown))
                out.append(("" if shown else clean_name(name), address or shown))
            else:
                out += [self.entry(v, "") for v in self.split_plain(gap)]
                if m.group("path") is not None:
                    values = self.split_plain(m.group("pathname"))
                    out += [self.entry(v, "") for v in values[:-1]]
                    out.append((clean_name(values[-1]) if values else "", ""))
                elif m.group("bare") is not None:
                    out.append((clean_name(m.group("remark") or ""), m.group("address").strip("'").lower()))
                else:
                    quoted = m.group("name2") if m.group("q2") is not None else m.group("name3")
                    out.append(self.entry(quoted, ""))
            at = m.end()
        out += [self.entry(v, "") for v in self.split_plain(text[at:])]
        return [(n, a) for n, a in out if a or is_name(n)]

    @staticmethod
    def entry(value: str, address: str) -> tuple[str, str]:
        address = address or address_of(value)
        return ("" if address else clean_name(value), address)


def joined(elements: list[str | None] | None) -> str | None:
    """A list that was cut at commas, whole again; values a comma really divided are kept
    apart by a semicolon."""
    if not elements:
        return None
    out: list[str] = []
    inside = False  # an open quotation mark: the comma belongs to a name
    for e in elements:
        if e is not None:
            out += [", " if inside else " ; ", e] if out else [e]
            inside ^= e.count('"') % 2 == 1
    return "".join(out)


def name_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name): the quoted names of the given columns that hold a delimiter or blank, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: set[str] = set()
            for column in batch.columns:
                for value in column.to_pylist():
                    text = joined(value) if isinstance(value, list) else value
                    if text:
                        for quoted, single in re.findall(r"\"([^\"<>@]{3,60})\"\s*<|'([^'\"<>@;|\t\n]{3,60})'", text):
                            name = clean_name(quoted or single)
                            if is_name(name) and re.search(r"[,; ]", name):
                                names.add(name.lower())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string())], names=["name"])

    return df.select(*columns).mapInArrow(run, "name string").distinct()


class Asker(Segmenter):
    """Collects, in `asked`, the values that the covers of a text could take from a dictionary."""

    def __init__(self, commas: bool = True):
        super().__init__([], commas)
        self.asked: set[str] = set()

    def split_plain(self, text: str) -> list[str]:
        low = text.lower()
        if re.search(r"[;|]", low):
            self.asked |= parts_around(low)
        if self.commas and "," in low:
            self.asked |= parts_between(low)
        return []


def parts_around(text: str) -> set[str]:
    """The parts of a lower-cased text between ends of words that hold a semicolon or bar, which
    only the dictionary keeps whole."""
    out = set()
    for run in re.split(r"[\"<>@/]", text):  # no name holds these
        starts = [m.start() for m in re.finditer(r"(?<![^\s,;|'])[^\s,;|]", run)]
        ends = [m.end() for m in re.finditer(r"[^\s,;|](?=[\s,;|'(]|\Z)", run)]
        for m in re.finditer(r"[;|]", run):
            at = m.start()
            for a in starts[bisect.bisect_left(starts, at - LONGEST) : bisect.bisect_left(starts, at)]:
                out.update(run[a:b] for b in ends[bisect.bisect_right(ends, at) : bisect.bisect_right(ends, a + LONGEST)])
    return out


def parts_between(text: str) -> set[str]:
    """The values that a cover of a lower-cased text can be made of: neighbours among the parts at its commas."""
    out = set()
    for run in re.split(r"[;|\t\n]", text):
        parts = [p.strip() for p in run.split(",")]
        for i in range(len(parts)):
            value = ""
            for part in parts[i:] if len(parts) > 1 else []:
                value = f"{value}, {part}" if value else part
                if not part or len(value) > LONGEST:
                    break
                if re.search("[, ]", value):
                    out.add(value)
    return out


def asked_names(rows: DataFrame, key: str, lists: list[str], headers: list[str]) -> DataFrame:
    """(key, name): what each row's fields could take from a dictionary, in lower case. Of a row
    only its key is given with them, and few values at a time, however many a row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for_lists, for_headers = Asker(commas=False), Asker()
        for batch in _slices(batches):
            take, names = [], []
            fields = [(for_lists if c in lists else for_headers, batch.column(i + 1).to_pylist()) for i, c in enumerate([*lists, *headers])]
            for i in range(batch.num_rows):
                asked: set[str] = set()
                for asker, values in fields:
                    if values[i]:
                        asker.asked = asked
                        asker.entries(joined(values[i]) if asker is for_lists else values[i])
                        asked = asker.asked
                take += [i] * len(asked)
                names += sorted(asked)
                if len(names) > VALUES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(names, pa.string())], names=[key, "name"])
                    take, names = [], []

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("name", T.StringType())])
    return rows.select(key, *lists, *headers).mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _with_names(rows: DataFrame, lists: list[str], headers: list[str], names: DataFrame) -> DataFrame:
    """Adds `__known`, the names of the table that the given columns of a row could be covered with.
    Rows are told by a hash of these columns: if two share it, each gets names that do not
    stand in its texts besides its own, which change nothing."""
    hashed = rows.withColumn("__row", F.xxhash64(*lists, *headers))
    asked = asked_names(hashed, "__row", lists, headers).distinct()
    known = asked.join(names, "name").groupBy("__row").agg(F.collect_set("name").alias("__known"))
    return hashed.join(known, "__row", "left").drop("__row")


def unpack(df: DataFrame, key: str, lists: list[str], headers: list[str], dictionary: list[str] | None = None, limit: int = DICTIONARY_LIMIT) -> DataFrame:
    """(key, hdr, pos, name, address): one row per value packed into the given fields.

    `lists` are arrays left by cutting an address list at commas (elements may be fragments
    or hold several values), `headers` are typed header strings. pos counts the values of a
    field from 1. name or address may be '' but not both; an address is in lower case. A name
    that only repeats or resembles an address is no value of its own, and null, blank, empty
    and undisclosed lists have none. Repeated rows give repeated rows; values may repeat
    within a field and keep their places; other columns are ignored. More names than `limit`
    are joined to the fields instead of broadcast.
    """
    names, known = None, dictionary
    if known is None:
        names = name_table(df, [*lists, *headers])
        known = sorted(r.name for r in names.limit(limit + 1).collect())
        names, known = (None, known) if len(known) <= limit else (names, [])
    joins = names is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for_headers = Segmenter(known)
        for_lists, for_headers = plain = for_headers.for_lists(), for_headers
        given = [key, "hdr", "pos", "name", "address"]
        for batch in _slices(batches):
            take, hdr, pos, name, address = [], [], [], [], []
            columns = {c: batch.column(i + 1).to_pylist() for i, c in enumerate([*lists, *headers])}
            own = batch.column(batch.num_columns - 1).to_pylist() if joins else None
            for i in range(batch.num_rows):
                if own:
                    for_lists, for_headers = ((s := Segmenter(own[i])).for_lists(), s) if own[i] else plain
                for c, values in columns.items():
                    if not values[i]:
                        continue
                    entries = for_lists.entries(joined(values[i])) if c in lists else for_headers.entries(values[i])
                    for p, (n, a) in enumerate(entries, 1):
                        take.append(i)
                        hdr.append(c)
                        pos.append(p)
                        name.append(n)
                        address.append(a)
                if len(take) > VALUES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(hdr, pa.string()), pa.array(pos, pa.int64()), pa.array(name, pa.string()), pa.array(address, pa.string())], names=given)
                    take, hdr, pos, name, address = [], [], [], [], []

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("hdr", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("name", T.StringType()), T.StructField("address", T.StringType())])
    rows = df.select(key, *lists, *headers)
    return (_with_names(rows, lists, headers, names) if joins else rows).mapInArrow(run, schema)
