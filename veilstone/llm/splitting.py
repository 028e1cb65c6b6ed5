"""Splitting oversized texts at natural boundaries, with an overlap.

Balanced targets: the smallest possible number of pieces is computed, equal-length targets
are placed, each target is moved to the strongest boundary near it, and a piece is added
whenever a limit fails. Boundaries are, from strong to weak: section heads, paragraph
breaks, sentence ends, line breaks, clause marks, blanks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 6000, 200

_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
_TITLE_WORD = r"[A-Z][\w'’-]*"
_TITLE = rf"{_TITLE_WORD}(?: (?:(?:and|of|the|to|for|in|on|by|or|a|an|with|at|from) )*{_TITLE_WORD}){{0,6}}"
_DASHED = re.compile(rf"(?<!\S)(-{{2,}}|–|—) ({_TITLE}) \1(?!\S)")
_MARKED = re.compile(rf"(?<!\S)(?:\[([IVXLC]+|\d+|[A-Z])\]|§ ?(\d+|[IVXLC]+)\.?(?![\d.])) (?={_TITLE})")
_NUMBERED = re.compile(rf"(?<!\S)(\d{{1,2}}|[IVXLC]+|[A-Z])[.)] (?={_TITLE})")
_ALONE = re.compile(rf"\S+ {_TITLE_WORD}(?:\s+[A-Z§“\"]|[ \w]*\n| (?:(?:and|of|the|to|for|in|on) )+{_TITLE_WORD})")
_SEPARATOR = re.compile(r"(?<!\S)(?:\*(?: ?\*){2,}|(?:# ?){3,}|(?:~ ?){3,}|(?:= ?){5,}|_{5,}|-{5,}|(?:• ?){3,}|⁂|§ § §|(?:- ){2,}-|o0o|oOo)(?!\S)")
_CAPITALS = re.compile(r"(?<!\S)[A-Z][A-Z'’-]+(?: (?:[A-Z][A-Z'’-]*))*(?!\S)")
_OWN_LINE = re.compile(_TITLE)
#: First characters of the marks above. Searching for them first is several times faster than trying a mark everywhere.
_DASHES, _MARKS, _SEPARATES, _CAPITAL = re.compile("-{2}|[–—]"), re.compile(r"[\[§]"), re.compile("[*#~=_•⁂§-]|o[0O]o"), re.compile("[A-Z][A-Z'’-]")
_LABELLED = re.compile("[0-9A-Z][.)](?= [A-Z])")
#: Characters of pieces in one batch of the result.
_BATCH_CHARS = 4_000_000
_ABBREVIATION = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|No|Nos|Inc|Co|Corp|Ltd|Jr|Sr|St|Ct|App|Div|Dist|Rep|Sup|Cir|Supp|Rptr|Cal|Id|sec|Sec|art|Art|cl|ch|para|pp|v|vs|al|cf|Cf|e\.g|i\.e)|\b[A-Z])\.$")
_PART = re.compile(r"(?i)\b(?:part|sec|section|article|art|rule|title|chapter|clause|exhibit|no|nos|appendix|schedule|under|count|item|paragraph|para|ch|cl|see|id|at|§)\.?$")


def _rank(label: str) -> int | None:
    """The place in its row that a number, roman number or letter names."""
    if label.isdigit():
        return int(label)
    if all(c in _ROMAN for c in label):
        values = [_ROMAN[c] for c in label]
        return sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values))
    return ord(label) - 64 if len(label) == 1 else None


def _sentence_before(text: str, at: int) -> bool:
    """Whether a sentence, a paragraph or the text itself ends right before `at`."""
    before = text[max(0, at - 24) : at]
    line = before.rstrip(" \t")
    if not line or line.endswith("\n"):
        return True
    last = line.rstrip("\"”’')]*")
    return last.endswith((".", "!", "?")) and not _PART.search(last[:-1]) and not (_ABBREVIATION.search(last) and not last.endswith((").", "Inc.", "Co.")))


def _matches(pattern: re.Pattern, first: re.Pattern, text: str) -> Iterator[re.Match]:
    """What pattern.finditer(text) gives, tried only at words that begin as `first` does."""
    done = 0
    for m in first.finditer(text):
        at = m.start()
        if at >= done and (not at or text[at - 1].isspace()) and (found := pattern.match(text, at)):
            done = found.end()
            yield found


def _numbered(text: str) -> Iterator[re.Match]:
    """What _NUMBERED.finditer(text) gives, tried only before a period or bracket."""
    for m in _LABELLED.finditer(text):
        at = m.start()
        while at and not text[at - 1].isspace() and m.start() - at < 8:
            at -= 1
        if (not at or text[at - 1].isspace()) and (found := _NUMBERED.match(text, at)):
            yield found


def _longest_row(row: list[tuple[int, int]]) -> list[int]:
    """Offsets of the longest row of numbers that counts on by one, the first of equal ones."""
    last: dict[int, tuple[int, int]] = {}  # by its last number: (length, index of that number)
    before: list[int] = []
    top = (0, -1)
    for i, (n, _) in enumerate(row):
        size, at = last.get(n - 1, (0, -1))
        before.append(at)
        if size + 1 > last.get(n, (0, -1))[0]:
            last[n] = (size + 1, i)
        if last[n][0] > top[0]:
            top = last[n]
    out, i = [], top[1]
    while i >= 0:
        out.append(row[i][1])
        i = before[i]
    return out[::-1]


def section_starts(text: str) -> list[int]:
    """Offsets of the section heads of a text, 0 first.

    Dashed, bracketed and paragraph-marked heads and separators are heads by their form.
    Numbers and letters with a period head a section only in a row of at least two that
    counts on by one, on a line of their own, or alone where a sentence ends before and
    another starts after the title; a title in capitals only where a sentence
    has ended, a bare title only on a line of its own.
    """
    found = {0}
    found.update(m.start() for m in _matches(_SEPARATOR, _SEPARATES, text))
    found.update(m.start() for m in _matches(_DASHED, _DASHES, text))
    for m in _matches(_MARKED, _MARKS, text):
        before = text[max(0, m.start() - 16) : m.start()].rstrip()
        if not _PART.search(before) and (m.group(1) or _sentence_before(text, m.start()) or not re.search(r"[a-z,]$", before) or before.endswith(")")):
            found.add(m.start())
        elif m.group(2) and not _PART.search(before) and not before.endswith((",", "in", "of", "to", "and", "by", "with", "the")):
            found.add(m.start())
    rows: dict[str, list[tuple[int, int]]] = {"digit": [], "roman": [], "letter": []}
    for m in _numbered(text):
        label, at = m.group(1), m.start()
        before = text[max(0, at - 16) : at].rstrip(" \t")
        if _PART.search(before):
            continue
        own_line = (not before or before.endswith("\n")) and bool(re.match(rf"[^\n]{{0,4}}[.)] {_TITLE}[ \t]*(?:\n|\Z)", text[at : at + 120]))
        if own_line:
            found.add(at)
        if not own_line and not _sentence_before(text, at):
            if re.search(r"[,;&(]$|\b(?:v|and|of|the|by|to|for|with|that|Mr|Mrs|Ms|Dr|Judge|Justice)\.?$", before):
                continue
        kind = "digit" if label.isdigit() else "letter" if len(label) == 1 and label not in "IVX" else "roman"
        rows[kind].append((_rank(label), at))
        if len(label) == 1 and label in "CDILVX":
            rows["letter" if kind == "roman" else "roman"].append((_rank(label) if kind == "letter" else ord(label) - 64, at))
    for row in rows.values():
        best = _longest_row(sorted((x for x in row if x[0] is not None), key=lambda x: x[1]))
        if len(best) > 1:
            found.update(best)
        found.update(at for _, at in row if _sentence_before(text, at) and _ALONE.match(text[at : at + 120]))
    heads = sorted(found)
    for m in _matches(_CAPITALS, _CAPITAL, text):
        at, words = m.start(), m.group().split(" ")
        if len(words[-1]) == 1 and len(words) > 1:
            words = words[:-1]  # the A or I that opens the next sentence
        if len(" ".join(words)) < 4 or len(words) > 7 or all(_rank(w) and all(c in _ROMAN for c in w) for w in words):
            continue
        after = text[at + len(" ".join(words)) :][:2]
        if not _sentence_before(text, at) or not re.match(r"\s[\s\"“A-Z\[§\d(]|\Z", after):
            continue
        i = bisect_right(heads, at) - 1
        label = text[heads[i] : at]
        if heads[i] and at - heads[i] < 10 and re.fullmatch(r"(?:\[?\w{1,5}[.\])]|§ ?\w{1,5}\.?|[-–—]+)\s", label):
            continue  # the title of a numbered head
        found.add(at)
    line = 0
    while line < len(text):
        end = text.find("\n", line)
        end = len(text) if end < 0 else end
        at = line
        while at < end and text[at] in " \t":
            at += 1
        title = text[at:end].rstrip(" \t") if end - at < 200 else ""
        above = text[max(0, at - 3) : at]
        if title[:1].isupper() and len(title) <= 60 and at and "\n" in above and _OWN_LINE.fullmatch(title) and _sentence_before(text, at) and re.search(r"[.!?\"”)*-]\s*$", text[max(0, at - 6) : at]):
            found.add(at)
        line = end + 1
    return sorted(found)


_LEVELS = tuple(re.compile(p) for p in (r"\n[ \t]*\n\s*", r"[.!?][\"”’')\]]*\s+(?=[\"“‘'(\[§]?[A-Z0-9])", r"\n", r"[;:,–—]\s+", r"\s+"))


def boundaries(text: str) -> tuple[Iterable[list[int]], list[int]]:
    """Cut offsets by falling strength, each kind searched for when it is first asked for, and the section starts."""
    sections = section_starts(text)

    class Levels:
        known = [sections[1:]]

        def __iter__(self) -> Iterator[list[int]]:
            for i in range(len(_LEVELS) + 1):
                if i == len(self.known):
                    self.known.append([m.end() for m in _LEVELS[i - 1].finditer(text)])
                yield self.known[i]

    return Levels(), sections


def balanced_cuts(length: int, levels: Iterable[list[int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """The offsets at which pieces after the first start.

    The first piece may have `limit` characters, each later one limit - overlap new ones.
    """
    if length <= limit:
        return []
    body = limit - overlap
    pieces = 1 + -(-(length - limit) // body)
    while True:
        cuts: list[int] = []
        at = 0
        step = (length + (pieces - 1) * overlap) / pieces  # equal lengths, overlaps counted
        for k in range(1, pieces):
            target = int(step * k - overlap * (k - 1))
            top = at + (limit if k == 1 else body)
            # what remains must fit the remaining pieces
            low = max(at + 1, length - body * (pieces - k))
            if low > top:
                break
            reach = int(step / 4)
            lo, hi = max(low, target - reach), min(top, target + reach)
            if lo > hi:
                lo, hi = low, top
            cut = min(max(target, low), top)
            for level in levels:
                near = level[bisect_left(level, lo) : bisect_right(level, hi)]
                if near:
                    cut = min(near, key=lambda x: (abs(x - target), x))
                    break
            cuts.append(cut)
            at = cut
        if len(cuts) == pieces - 1 and length - at <= body:
            # one piece more where a cut fell into the open text although the limits left no choice
            return cuts
        pieces += 1


def split_oversized(df: DataFrame, key: str, text: str = "message", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, pieces, start, end, text, sections): the ordered pieces of every text, and their number.

    Piece 0 starts at offset 0; the text of a later piece begins with the last `overlap`
    characters before its start; none has more than `limit` characters, counted in code
    points. `end` is the start of the next piece. `sections` are the section starts inside
    [start, end), looked for only in texts over the limit (elsewhere just 0). A text without
    any boundary is cut at the target. Null texts give no rows, an empty text one empty
    piece. Rows are taken as they come: repeated rows give repeated pieces; other columns
    are ignored. One text is handled by one task, whatever its length.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    kinds = [("piece", pa.int64()), ("pieces", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("sections", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            rows: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                keys = batch.column(0).take(pa.array(take, pa.int64()))
                return pa.RecordBatch.from_arrays([keys, *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds))], names=[key, *(name for name, _ in kinds)])

            for i, t in enumerate(batch.column(1).to_pylist()):
                if len(t) <= limit:
                    cuts, sections = [], [0]
                else:
                    levels, sections = boundaries(t)
                    cuts = balanced_cuts(len(t), levels, limit, overlap)
                starts, ends = [0, *cuts], [*cuts, len(t)]
                take += [i] * len(starts)
                rows += [(n, len(starts), a, b, t[max(0, a - overlap) : b], sections[bisect_left(sections, a) : bisect_left(sections, b)] if t else [0]) for n, (a, b) in enumerate(zip(starts, ends))]
                size += len(t)
                if size > _BATCH_CHARS:
                    yield flush()
                    take, rows, size = [], [], 0
            yield flush()

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("piece", T.LongType()), T.StructField("pieces", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sections", T.ArrayType(T.LongType()))])
    return df.select(F.col(key), F.col(text).cast("string").alias("__t")).filter("__t is not null").mapInArrow(run, schema)
