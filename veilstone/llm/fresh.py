"""The newly written text of a mail.

Every message is winnowed into fingerprints of its eight-word runs. Two questions go to the
inverted index of all fingerprints: which runs recur under many unlike messages (legal
notices and other recurring closings), and which other message wrote what a quotation holds,
without any thread identifier. The answers settle what marks alone leave open: where a
closing begins in running text, and where a quoted line ends and an answer begins once line
breaks are lost. Spans found this way are verified against the text before they are removed.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .near import _Hashed

#: Words of a fingerprinted run, and runs of a winnowing window.
RUN, WINDOW = 8, 8
#: A run recurs if it lies in this share of the messages, and in LEAST unlike ones.
RECURS, LEAST = 0.002, 6
#: Recurring runs that are broadcast at most (8 bytes each). By counting, RECURS allows no more than
#: fingerprints-per-message / RECURS of them; a run with more is refused with an error.
RECURRING_LIMIT = 2_000_000
#: Parts by hash into which the holders of a run are cut, so that one task never holds all of a hot run.
PARTS = 8
#: Quoted lines are wrapped to this width at most, their mark included.
WIDTH = 72
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_DASH = r"-{3,}"
_NAME = r"[A-Z][\w'’é-]*\.?"
_FIRM = r"(?:Inc|Co|Corp|LLC|Ltd|LP|LLP|Company|Corporation|Group|Grp|Bank|Offices|Services|Partners)\.?"
#: Marks after which everything is older mail (formats of mail programs; fixed values).
_CUT = re.compile(
    rf"""{_DASH}\s*Original\s+Message\s*{_DASH}
    |-{{5,}}\s*Forwarded\s+by\s(?:(?!-{{5}}).){{3,160}}-{{5,}}
    |_{{20,}}\s+From:\s
    |(?<!\S)From:\s(?:(?!From:).){{3,120}}?\s(?:Sent|Date):\s(?:(?!From:).){{6,80}}?\s(?:To:\s(?:(?!From:).){{2,400}}?\s)?(?:[Cc]c:\s(?:(?!From:).){{0,400}}?\s?)?Subject:""",
    re.X | re.S,
)
_NOTES = re.compile(r"(?<!\S)\d\d/\d\d/\d{4}\s+\d\d:\d\d\s+[AP]M\s+To:\s")
_BEGIN = re.compile(rf"{_DASH}\s*Begin\s+forwarded\s+message\s*{_DASH}")
_ATTRIBUTION = re.compile(
    r"""On\s\w{3},\s\w{3}\s\d{1,2},\s\d{4}\sat\s\d{1,2}:\d\d,\s(?:(?!\swrote:).){2,140}\swrote:
    |Le\s\d{1,2}/\d\d/\d{4}\sà\s\d{1,2}:\d\d,\s(?:(?!\sa\sécrit).){2,110}\sa\sécrit\s?:
    |Am\s\d\d\.\d\d\.\d{4}\sum\s\d{1,2}:\d\d\sschrieb\s[^:>]{2,110}:""",
    re.X | re.S,
)
_WRITES = re.compile(r"(?<!\S)writes:(?=\s*(?:>|\Z))")
_CLOSING_WORDS = r"(?:Thank you|Thanks|Many thanks|Best|Best regards|Kind regards|Regards|Cheers|Talk soon|Sincerely|Yours|Take care|All the best|Warm regards)"
_CLOSERS = ("Thanks", "Best", "Regards", "Cheers", "Talk soon", "Sincerely", "Kind regards")
#: First words of notices whose first sentence names a firm (fixed values).
_LEAD = r"Diese (?:Nachricht|E-Mail)|This (?:e-?mail|message|transmission|electronic)|The views above|Ce message|Este mensaje|The information"
_DEVICE = re.compile(r"(?<!\S)(?:Sent\s(?:from\smy|via|using)\s|Get\s(?:free|your)\s(?:\w+\s){0,3}(?:at|from)\s|Von\smeinem\s\w+\sgesendet|Envoyé\sde\smon\s)")
_SIGN = re.compile(r"(?<!\S)(?:--|_{5,}|={5,}|\*{5,})\s+(?=[A-Z\"+(\d])")
_NOTICE = re.compile(r"(?<!\S)(?:\*{5,}\s+)?(?:[A-Z]{4,}\s)?NOTICE\s?(?::|-)\s|(?<!\S)\*{5,}\s+(?=[A-Z])")
_GREETING = re.compile(rf"(?:(?:Dear|Hi|Hello|Good morning|Good afternoon)\s)?{_NAME}(?:\s{_NAME})?(?:,|\s-)(?=\s|\Z)")
_FULL_NAME = re.compile(rf"(?<![\w'’@.-])({_NAME})((?:\s(?:[A-Z]\.?){{1,2}}(?=\s))?)\s([A-Z][\w'’é-]*)(?![\w'’@])")
#: What follows the full name in a contact block: a title, a bar, a label or number, an address.
_AFTER_NAME = re.compile(
    r"""\s*(?:\||\s(?:Director|Manager|Vice|Senior|Staff|Associate|Executive|Systems|Credit|Project|Trading|Contracts?|Regulatory|Records|Paralegal
    |Analyst|Assistant|Counsel|Engineer|President|General|Chief|Accountant|Administrator|Specialist|Coordinator|Attorney|Partner|Head|Lead)\b
    |\s(?:Tel|Phone|Direct|Fax|Cell|Mobile|E-?mail|Office)\b:?|\s\([a-z]\)|\s[+(\d]|\smailto:|\s[\w.-]+@|\sP\.O\.)""",
    re.X,
)
_FIRM_NAME = re.compile(rf"(?<!\S)(?:The\s)?([A-Z][\w'’é-]*)(?:\s[A-Z&][\w'’é.-]*){{0,3}},?\s{_FIRM}(?:,\s(?:Inc|LLC|Ltd|Co)\.?)?(?!\S)")
_SENTENCE_END = re.compile(r"[.!?][\"”’)]*(?=\s|\Z)")


_OTHER = re.compile("[^a-z0-9@]+")


def fold(text: str) -> str:
    """Lower-cased letters and digits without accents; other characters as blanks."""
    if text.isascii():
        return _OTHER.sub(" ", text.lower())
    plain = unicodedata.normalize("NFKD", text.lower())
    return _OTHER.sub(" ", "".join(c for c in plain if not unicodedata.combining(c)))


class Winnower:
    """Fingerprints by (hash, word index) of a text."""

    def __init__(self) -> None:
        self.hashed = _Hashed()

    def grams(self, found: list[str]) -> np.ndarray:
        h = np.fromiter(map(self.hashed.__getitem__, found), np.uint64, len(found))
        n = len(h) - RUN + 1
        if n < 1:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(RUN):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            out ^= out >> np.uint64(31)
        return out * np.uint64(0xD6E8FEB86659FD93)

    def pick(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The smallest hash of every window of runs, once each, with its place."""
        g = self.grams(found)
        if len(g) <= WINDOW:
            at = np.array([int(g.argmin())]) if len(g) else np.empty(0, np.int64)
        else:
            n = len(g) - WINDOW + 1
            at = np.ndarray((n, WINDOW), g.dtype, g, strides=(8, 8)).argmin(1) + np.arange(n)
            new = np.empty(n, bool)  # the places never fall from one window to the next
            new[0] = True
            np.not_equal(at[1:], at[:-1], out=new[1:])
            at = at[new]
        return g[at].view(np.int64), at

    def pick_many(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the text) of what pick gives for each text, in one pass."""
        return self.places(texts)[:2]

    def places(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What pick_many gives, with the place of each hash among the words of its text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        g = self.grams(list(chain.from_iterable(texts)))
        if not len(g):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        g[owner[: len(g)] != owner[RUN - 1 :]] = _NONE  # runs across two texts
        owner = owner[: len(g)]
        # a window that leaves its text sees only the runs left in it
        padded = np.concatenate([g, np.full(WINDOW - 1, _NONE)])
        view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
        at = view.argmin(1) + np.arange(len(g))
        short = (sizes >= RUN) & (sizes - RUN + 1 < WINDOW)
        last = np.arange(len(g)) + WINDOW - 1 + RUN - 1
        whole = np.concatenate([owner, np.full(RUN - 1, owner[-1]), np.full(WINDOW - 1, -1)])
        inside = (whole[last] == owner) | (short[owner] & np.concatenate([[True], owner[1:] != owner[:-1]]))
        at = np.unique(np.minimum(at[inside], len(g) - 1))
        at = at[g[at] != _NONE]
        return g[at].view(np.int64), owner[at], at - (np.cumsum(sizes) - sizes)[owner[at]]


def tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


@lru_cache(maxsize=50_000)
def _header(header: str) -> tuple[str, str | None, tuple[str, ...]]:
    """(the header folded, the local part of its address, the words of its name)."""
    from ..operators.packed import address_of, clean_name

    address = address_of(header)
    named = "@" not in re.split("[<>/]", header)[0]
    return fold(header), fold(address.split("@")[0]).strip() if address else None, tuple(fold(re.sub(r"\([^)]*\)", "", clean_name(header))).split()) if named else ()


@lru_cache(maxsize=100_000)
def _word(text: str) -> str:
    """A word folded and stripped; the words of names come again and again."""
    return fold(text).strip()


class Sender:
    """What is known of a sender's name from the two sender headers."""

    def __init__(self, *headers: str | None):
        self.tokens: set[str] = set()
        self.locals: list[str] = []
        self.all = ""
        for header in headers:
            if header:
                every, local, names = _header(header)
                self.all += " " + every
                if local is not None:
                    self.locals.append(local)
                self.tokens.update(names)
        self.known: dict[tuple[str, str], bool] = {}
        self.words = {w.rstrip("0123456789") for local in self.locals for w in local.split()} | self.tokens

    def has(self, word: str, exact: bool = False) -> bool:
        """Whether a folded word is one of the sender's, one letter amiss allowed in a long one."""
        if word in self.words or any(len(x) > 3 and (x[1:] == word) for x in self.words):
            return True
        return not exact and len(word) > 4 and any(abs(len(word) - len(s)) <= 1 and s[0] == word[0] and (sorted(s) == sorted(word) or sum(x == y for x, y in zip(word, s)) + sum(x == y for x, y in zip(word[::-1], s[::-1])) >= len(word)) for s in self.words if len(s) > 3)

    def is_own(self, given: str, surname: str) -> bool:
        """Whether "given surname" is the sender's full name."""
        if (given, surname) not in self.known:
            self.known[given, surname] = self._is_own(given, surname)
        return self.known[given, surname]

    def _is_own(self, given: str, surname: str) -> bool:
        a, b = _word(given), _word(surname)
        if len(b) < 3 or not a or a == b or not self.has(b) or (given.endswith(".") and len(given) > 2):
            return False
        others = {w for w in self.words if w != b and not (len(w) > 4 and w[:4] == b[:4])}
        glued = [w for w in self.words if w[1:] == b]
        if a in others or any(w[0] == a[0] and (len(w) == 1 or w.startswith(a[:3])) for w in others) or any(w[0] == a[0] for w in glued):
            return True
        if any(len(w) <= 2 and a[0] in w for w in others):
            return True
        return not [w for w in others if len(w) > 2 and w[1:] != b]

    def is_firm(self, first: str) -> bool:
        return self.has(_word(first))

    def knows(self, word: str) -> bool:
        """Whether a single word can be the sender's typed name."""
        w = _word(word).replace(" ", "")
        return bool(w) and (w[:3] in self.all or len(w) <= 3)


_PROSE, _NO_WORD = re.compile(r"(?<!\S)[a-z]{2,}[,;]?(?!\S)"), re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_NEXT_SENTENCE = re.compile(r"[a-z]{3,}[.!?]\s+[A-Z][a-z]+\s[a-z]+\s[a-z]+")


def _like_block(text: str) -> bool:
    """Whether a text reads like a contact block rather than sentences."""
    words, prose = len(text.split()), len(_PROSE.findall(text))
    if prose > 0.2 * words + 0.5:
        return False
    words -= len(_NO_WORD.findall(text))
    return not words or (prose <= 0.2 * words + 0.5 and not _NEXT_SENTENCE.search(text))


def _reach(text: str, end: int, size: int) -> int:
    """From where a closing that ends at `end` is looked for: `size` characters before it, and
    twice as many as long as all of them read like a block, which then may begin still earlier."""
    while size < end and _like_block(text[end - size : end]):
        size *= 2
    return max(0, end - size)


def signature_start(text: str, sender: Sender, end: int) -> int | None:
    """Where the block with full name, title, firm or contacts begins in text[:end]."""
    low = _reach(text, end, 500)
    options = []
    for m in _SIGN.finditer(text, low, end):
        if _like_block(text[m.end() : end]):
            options.append(m.start())
    names, at = [], low
    while m := _FULL_NAME.search(text, at, end):
        names.append(m)
        at = m.start(3) if not m.group(2) else m.start() + len(m.group(1))
    for i, m in enumerate(names):
        follows = text[m.end() : end]
        own = sender.is_own(m.group(1), m.group(3))
        if not own and not (len(m.group(3)) > 2 and _AFTER_NAME.match(follows) and follows.strip() and not re.search(r"[a-z]\.\s*\Z", follows)):
            continue
        if re.fullmatch(_CLOSING_WORDS, m.group(1)) or (m.group(1).endswith(".") and len(m.group(1)) > 2) or not _like_block(text[m.start() : end]):
            continue
        # a typed first name or initials may stand before the full name
        later = names[i + 1] if i + 1 < len(names) and names[i + 1].start() == m.start(3) else None
        if later and own and sender.is_own(later.group(1), later.group(3)) and not _AFTER_NAME.match(follows):
            m = later
        before = text[: m.start()].rstrip()
        last = before.rsplit(None, 1)[-1] if before else ""
        if not before or before[-1] in ".!?,;:)*\"-_" or "\n" in text[len(before) : m.start()] or last.lstrip("-")[:1].isupper() or re.search(r"\w@|\d$", last):
            options.append(m.start())
            break
    for m in _FIRM_NAME.finditer(text, low, end):
        if sender.is_firm(m.group(1)) and _like_block(text[m.end() : end]) and re.search(r"\w", text[m.end() : end]):
            options.append(m.start())
    return min(options) if options else None


def notice_start(text: str, start: int, sender: Sender, recurring: np.ndarray, winnower: Winnower) -> int | None:
    """Where the recurring closing that ends the text begins, if it ends with one. The end of the
    text is looked at first; as long as it recurs from its beginning on, twice as much."""
    if not len(recurring):
        return None

    def places_in(words: list[str]) -> np.ndarray:
        picked, at = winnower.pick(words)
        where = np.searchsorted(recurring, picked)
        return at[(where < len(recurring)) & (recurring[np.minimum(where, len(recurring) - 1)] == picked)]

    size, best = 900, None
    while True:
        tail_from = max(start, len(text) - size)
        found = tokens(text[tail_from:])
        places = places_in(found)
        spans = [(m.start() + tail_from, m.end() + tail_from) for m in re.finditer(r"\w+", text[tail_from:])] if len(places) and len(found) - (places[-1] + RUN) <= 4 * RUN else []
        if len(spans) != len(found) or not found:  # it does not reach the end
            if best is None:
                return None
            break
        first = int(places[-1])
        for p in places[::-1]:
            if first - (p + RUN) > WINDOW:
                break
            first = int(p)
        if best is not None and spans[first][0] >= best[0][best[1]][0]:
            break
        best = spans, first
        if tail_from == start or first > 22:
            break
        size *= 2
    spans, first = best
    # the closing starts at most a window before its first fingerprint
    far = spans[max(0, first - 22)][0]
    earliest = spans[max(0, first - WINDOW + 1)][0]
    head = spans[first][0]
    opened = [m.start() for m in re.finditer(rf"{_NOTICE.pattern}|(?<!\S)(?:{_LEAD})\b", text[start:]) if far - 16 <= m.start() + start <= head]
    if opened:
        begin = start + opened[0]
    else:
        starts = [m.end() for m in re.finditer(r"(?:[.!?*][\"”’)]*\s+|\n\s*\n\s*)", text[:head][far:] if not far else text[far:head])]
        starts = [far + s for s in starts if text[far + s : far + s + 1].isupper() or text[far + s : far + s + 1] == "-"]
        inside = [s for s in starts if s >= earliest]
        if inside:
            begin = inside[-1]
        elif starts and not inside and earliest > start + 2:
            begin = starts[-1]
        else:
            begin = start if far <= start + 2 else earliest
    # a typed closing right before it is the sender's own
    before = text[max(start, begin - 24) : begin]
    m = re.match(rf"(?:{_CLOSING_WORDS},?\s+)?(-?)({_NAME}|[A-Z]{{2,3}})\s+(?=[A-Z*])", text[begin:])
    if m and (m.group(1) or m.group().startswith(tuple(_CLOSERS)) or sender.knows(m.group(2)) or re.search(rf"{_CLOSING_WORDS},?\s*\Z", before)) and not opened:
        follows = re.match(_NAME, text[begin + m.end() :])
        if not (follows and sender.is_own(m.group(2), follows.group())):
            begin += m.end()
    stars = re.search(r"\*{5,}\s+\Z", text[start:begin])
    return start + stars.start() if stars else begin


def _strip_closing(piece: str, sender: Sender, recurring: np.ndarray, winnower: Winnower, width_of_line: bool) -> str:
    """A piece of new text without signature, device line and notices at its end."""
    end = len(piece)
    cut = notice_start(piece, 0, sender, recurring, winnower)
    if cut is not None:
        end = cut
    for m in _DEVICE.finditer(piece, _reach(piece, end, 400), end):
        if end - m.start() < 160 or _like_block(piece[m.end() : end]):
            end = m.start()
            break
    sign = signature_start(piece, sender, end)
    if sign is not None:
        end = sign
    # a device line may stand before the signature
    for m in _DEVICE.finditer(piece, max(0, end - 160), end):
        end = m.start()
        break
    return piece[:end]


def _name_before(text: str, at: int, known: str) -> int:
    """The start of the person's or firm's name that ends at `at`."""
    line = text.rfind("\n", 0, at) + 1
    before = text[line:at].rstrip()
    if line and not before:
        at = len(text[:line].rstrip())
        return text.rfind("\n", 0, at) + 1
    if line and line < at and len(before) < 60 and (len(before.split()) <= 6):
        return line
    m = re.search(rf"(?:The\s)?(?:{_NAME}(?:\s(?:&|and))?\s)+?{_NAME},?\s{_FIRM}$|(?:{_NAME}\s)?{_NAME}\s{_FIRM}$", before)
    if re.search(rf"{_FIRM}$", before) and m:
        words = list(re.finditer(r"\S+", before))
        i = len(words) - (4 if re.search(rf"{_FIRM},?\s(?:Inc|LLC|Ltd|Co)\.?$", before) else 3)
        i = max(0, i - 1 if i > 0 and words[i - 1].group() == "The" else i)
        return line + words[i].start()
    m = re.search(r"(?<!\S)(\S+\s+)((?:[A-Z]{1,2}\.?|[A-Z]\.[A-Z]\.)\s+)?(\S+)$", before)
    return line + m.start() if m else at


def quote_start(text: str) -> tuple[int, int, str] | None:
    """(start, end, kind) of the first quotation mark-up; kind 'cut' holds to the end."""
    best = None
    if ("From:" in text or "Original" in text or "Forwarded" in text) and (m := _CUT.search(text)):
        best = (m.start(), m.end(), "cut")
    if "To:" in text and (m := _NOTES.search(text)):
        s = _name_before(text, m.start(), "")
        if best is None or s < best[0]:
            best = (s, m.end(), "cut")
    for pattern, sure in ((_BEGIN, ("Begin",)), (_ATTRIBUTION, ("wrote:", "écrit", "schrieb"))):
        m = pattern.search(text) if any(word in text for word in sure) else None
        if m and (best is None or m.start() < best[0]):
            best = (m.start(), m.end(), "marked")
    m = _WRITES.search(text) if "writes:" in text else None
    if m:
        s = _name_before(text, m.start(), "")
        if best is None or s < best[0]:
            best = (s, m.end(), "marked")
    return best


def _answers_in_lines(text: str) -> list[str]:
    """The runs of unmarked lines after an attribution, in a text with line breaks."""
    out, run = [], []
    for line in text.split("\n"):
        if re.match(r"\s*>", line):
            if run:
                out.append("\n".join(run))
            run = []
        else:
            run.append(line)
    if run:
        out.append("\n".join(run))
    return out


def _line_end(chunk: str, ancestor: str | None) -> int:
    """Where the quoted line ends at the start of a chunk that is longer than a line."""
    if m := _GREETING.match(chunk):
        if m.end() < WIDTH:
            return m.end()
    ends = [m.end() for m in _SENTENCE_END.finditer(chunk[: WIDTH + 1]) if m.end() <= WIDTH]
    if ancestor and ends:
        # the longest of the possible ends whose words stand in the ancestor
        have = " " + " ".join(tokens(ancestor)) + " "
        true = [e for e in ends if " " + " ".join(tokens(chunk[:e])) + " " in have]
        if true:
            return true[-1]
        return ends[0]
    return ends[-1] if ends else len(chunk)


def _answers_in_flow(text: str, ancestor: str | None) -> list[str]:
    """The answers after an attribution in a text without line breaks: what a chunk between
    two quotation marks holds beyond one quoted line."""
    out = []
    chunks = re.split(r"(?<!\S)>+(?!\S)", text)
    for chunk in chunks[1:]:
        chunk = chunk.strip()
        if len(chunk) > WIDTH - 2:
            out.append(chunk[_line_end(chunk, ancestor) :])
    return out


def _marked(text: str) -> bool:
    """Whether any line behind an attribution has kept its mark."""
    return ">" in text and re.search(r"(?:^|\n)\s*>|(?<!\S)>+(?!\S)", text) is not None


def _answers_unmarked(text: str, ancestor: str | None) -> list[str]:
    """The answers behind an attribution none of whose lines has kept its mark: what stands beside
    the ancestor's words if it begins with them, they are most of it, and they are enough to share
    a fingerprint for sure; else nothing tells an answer from the quotation, and all of it is one."""
    words = tokens(text)
    if not ancestor or f" {' '.join(words[:RUN])} " not in f" {' '.join(_own_words(ancestor))} ":
        return []
    beside = without_quoted(text, ancestor)
    rest = len(tokens(beside))
    return [beside] if len(words) - rest > max(rest, RUN + WINDOW - 2) else []


def _own_words(message: str) -> list[str]:
    """What a message holds before any quotation of its own."""
    quoted = quote_start(message)
    return tokens(message[: quoted[0]] if quoted else message)


def _section(text: str) -> str:
    """The text behind an attribution up to the next quotation."""
    found = quote_start(text)
    return text if found is None else text[: found[0]]


def without_quoted(piece: str, ancestor: str) -> str:
    """A piece without the spans of at least RUN words that stand in what the ancestor's sender
    wrote, before any quotation of its own; punctuation behind a span goes with it."""
    have = _own_words(ancestor)
    runs = {tuple(have[i : i + RUN]) for i in range(len(have) - RUN + 1)}
    spans = list(re.finditer(r"\w+", piece))
    found = [m.group().lower() for m in spans]
    hits = [i for i in range(len(found) - RUN + 1) if tuple(found[i : i + RUN]) in runs]
    out, at, i = [], 0, 0
    while i < len(hits):
        first = last = hits[i]
        while i < len(hits) and hits[i] <= last + RUN:
            last = hits[i]
            i += 1
        out.append(piece[at : spans[first].start()])
        at = spans[last + RUN - 1].end()
        while at < len(piece) and piece[at] in ".,;:!?)\"”’":
            at += 1
    return " ".join([*out, piece[at:]]) if out else piece


def new_text(message: str, subject: str | None, sender: Sender, recurring: np.ndarray, winnower: Winnower, ancestor: str | None = None) -> tuple[str, bool]:
    """(newly written text with white space runs as one space, whether anything but it and
    the subject prefix was there)."""
    body, pieces = message, []
    if subject and message.startswith(subject + ". "):
        body = message[len(subject) + 2 :]
    elif subject and (message == subject + "." or message == subject):
        body = ""
    rest, marked = body, False
    while True:
        found = quote_start(rest)
        if found is None:
            tail, rest = rest, ""
        else:
            tail, rest = rest[: found[0]], rest[found[1] :]
        if not marked:
            pieces.append(tail)
        elif not _marked(tail):
            pieces += _answers_unmarked(tail, ancestor)
        else:
            pieces += _answers_in_lines(tail) if "\n" in body else _answers_in_flow(" " + tail, ancestor)
        if found is None or found[2] == "cut":
            break
        marked = True
    kept = [_strip_closing(p, sender, recurring, winnower, "\n" in body) for p in pieces]
    if ancestor:  # the first piece stands before any quotation
        kept[1:] = [without_quoted(p, ancestor) for p in kept[1:]]
    new = " ".join(" ".join(kept).split())
    return new, new != " ".join(body.split())


def open_quotation(message: str) -> list[str]:
    """The stretches of quoted words of a message whose quotation may hold an answer or a quoted
    line that has lost its mark: one with unmarked text of a run's length behind its attribution.
    Where no line has a mark, all of it is one stretch."""
    found = quote_start(message)
    if found is None or found[2] == "cut":
        return []
    if not _marked(tail := _section(message[found[1] :])):
        return [tail] * (len(tail.split()) >= RUN) + open_quotation(message[found[1] + len(tail) :])
    if "\n" in message:
        parts = [(line.lstrip().startswith(">"), line) for line in message[found[1] :].split("\n")]
        is_open = any(len(a.split()) >= RUN for a in _answers_in_lines("\n".join(line for _, line in parts)))
    else:
        parts = [(len(c) <= WIDTH - 2, c) for c in (c.strip() for c in re.split(r"(?<!\S)>+(?!\S)", message[found[1] :])[1:])]
        is_open = not all(short for short, _ in parts)
    return [" ".join(text for _, text in group) for quoted, group in groupby(parts, lambda p: p[0]) if quoted] if is_open else []


def fingerprint_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(fp, key, least, own): the winnowed fingerprints of every text; `least` is the smallest of
    the text, which near copies mostly share; `own` tells whether the run stands before any
    quotation of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                messages = batch.column(1).slice(start, 2000).to_pylist()
                texts = [tokens(t) if t else [] for t in messages]
                fps, at, place = winnower.places(texts)
                written_words = np.array([len(w) if not t or (q := quote_start(t)) is None else len(tokens(t[: q[0]])) for t, w in zip(messages, texts)], np.int64)
                least = np.full(len(texts), _NONE)
                np.minimum.at(least, at, fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fps), batch.column(0).take(pa.array(at + start)), pa.array(least.view(np.int64)[at]), pa.array(place + RUN <= written_words[at])], names=["fp", key, "least", "own"])

    schema = f"fp bigint, {key} {df.schema[key].dataType.simpleString()}, least bigint, own boolean"
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def recurring_runs(index: DataFrame, messages: int, recurs: float = RECURS, least: int = LEAST, limit: int = RECURRING_LIMIT) -> np.ndarray:
    """Fingerprints that lie in a share of the messages, near copies counted once, ascending."""
    need = max(least, int(recurs * messages))
    # unlike messages are counted by their smallest fingerprint, in two steps so that a notice in all messages is no hot spot
    unlike = index.select("fp", "least").distinct().groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") >= need).select("fp")
    rows = unlike.limit(limit + 1).toPandas()["fp"].to_numpy(np.int64)
    if len(rows) > limit:
        raise ValueError("more recurring runs than the limit; raise `recurs`")
    return np.sort(rows)


def ancestors(df: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ancestor text) for the messages with an open quotation: the other message whose own
    text, before any quotation, shares most of its fingerprints, ties to the smallest key. What a
    message only quotes itself gives it no vote, so copies of the asker and other answers to the
    same mail do not stand in for it; dates, which may be off, are not needed."""
    asked = df.select(F.col(key), F.col(text).cast("string").alias("t")).filter("contains(t, '>') or contains(t, 'wrote:') or contains(t, 'écrit') or contains(t, 'schrieb') or contains(t, 'Begin')")

    def quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower()
        for batch in batches:
            take, fps = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                picked = [winnower.pick(tokens(q))[0] for q in open_quotation(t)]
                if picked and len(found := np.unique(np.concatenate(picked))):
                    take.append(i)
                    fps.append(found.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(fps, pa.list_(pa.int64()))], names=["asker", "fps"])

    kind = df.schema[key].dataType.simpleString()
    asks = written(asked.mapInArrow(quote, f"asker {kind}, fps array<bigint>"), "asked")
    runs = asks.select(F.explode("fps").alias("fp")).distinct()
    # every holder has a vote; messages that hold the same of the wanted runs vote alike, so of them the two
    # smallest keys stand for all (two, as the asker may be one of them)
    held = index.filter("own").select("fp", key).join(runs, "fp", "left_semi").groupBy(key).agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    alike = Window.partitionBy("fps").orderBy(key)
    holders = written(held.withColumn("nth", F.row_number().over(alike)).filter("nth <= 2"), "holders")
    classes = holders.groupBy("fps").agg(F.min(key).alias("first"), F.max(key).alias("second"))
    part = F.pmod(F.xxhash64("first"), F.lit(PARTS)).cast("int")
    held_runs = classes.select("first", "second", part.alias("part"), F.explode("fps").alias("fp"))
    quotes = asks.groupBy("fps").agg(F.min("asker").alias("quote"))
    quoted_runs = quotes.select("quote", F.explode("fps").alias("fp")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    votes = quoted_runs.join(held_runs, ["fp", "part"]).groupBy("quote", "first", "second").agg(F.count("*").alias("n"))
    keys = votes.select("quote", "n", F.explode(F.array_distinct(F.array("first", "second"))).alias(key))
    most = Window.partitionBy("quote").orderBy(F.desc("n"), key)
    top = keys.withColumn("nth", F.row_number().over(most)).filter("nth <= 2")
    best = asks.join(quotes, "fps").select("asker", "quote").join(top, "quote").filter(F.col("asker") != F.col(key)).groupBy("asker").agg(F.min_by(key, "nth").alias(key))
    return best.join(df.select(key, F.col(text).alias("ancestor")), key).select(F.col("asker").alias(key), "ancestor")


def newly_written(df: DataFrame, key: str, text: str = "message", subject: str = "subject", senders: tuple[str, ...] = ("mail_from", "x_from"), recurs: float = RECURS) -> DataFrame:
    """(key, new_text, new_md5, trimmed) for every message that is not null.

    new_text has every white space run as one space; new_md5 is its hex MD5 as UTF-8;
    trimmed tells whether the message held anything but new text and the subject prefix.
    An empty message has the empty text and is not trimmed. Null subjects and senders are
    allowed. Give one row per key (one_per_key); repeated rows would give repeated rows.
    Other columns are ignored.
    """
    rows = df.select(key, F.col(text).cast("string").alias("t"), F.col(subject).cast("string").alias("s"), *(F.col(c).cast("string").alias(f"h{i}") for i, c in enumerate(senders))).filter("t is not null")
    index = written(fingerprint_index(rows, key, "t"), "index")
    recurring = recurring_runs(index, rows.count(), recurs)
    older = ancestors(rows, index, key, "t")
    open_rows = rows.join(older.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "left").drop("__k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        winnower = Winnower()
        met: dict[tuple, Sender] = {}
        for f in frames:
            out = []
            if len(met) > 50_000:
                met.clear()
            heads = list(zip(*(f[f"h{i}"] for i in range(len(senders))))) if senders else [()] * len(f)
            for t, s, h, a in zip(f["t"], f["s"], heads, f["ancestor"]):
                h = tuple(x for x in h if isinstance(x, str))
                if h not in met:
                    met[h] = Sender(*h)
                new, trimmed = new_text(t, s if isinstance(s, str) else None, met[h], recurring, winnower, a if isinstance(a, str) else None)
                out.append((new, hashlib.md5(new.encode()).hexdigest(), trimmed))
            yield pd.DataFrame({key: f[key], "new_text": [o[0] for o in out], "new_md5": [o[1] for o in out], "trimmed": [o[2] for o in out]})

    return open_rows.select(key, "t", "s", *(f"h{i}" for i in range(len(senders))), "ancestor").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, new_text string, new_md5 string, trimmed boolean")
