"""Problem 5: noise in text from scanned pages.

Three stages. (1) Corpus vocabulary: the number of texts that hold each word, over all texts; words held by a share
``word_share`` of them or more are kept. There are at most (different words of a text, on average) / word_share such words
whatever the size of the corpus, which bounds what is broadcast (as hashes, 8 bytes each). Rarer words are looked up by a shuffled join
with all the counts: of the words that scanned texts hold and the vocabulary doesn't know, what they are with a confusion undone, and what cut
words are joined. A rare word counts as known if three texts hold it, but as the right form of another only if it is held by ``DOMINANCE`` times as many texts. (2) Page furniture: page numbers are lines
that hold a number alone, in one of the usual forms, and follow one another as a sequence through the text; headers and footers
are short lines at the page edges the page numbers and repetitions mark out, told by fuzzy repetition (characters that scanners
confuse count as equal) or by being a title beside a page number. (3) Words: a word cut at a line end is joined with the next line of text, past furniture, if the mark is
a soft one or the vocabulary knows the joined word or doesn't know both halves; a hyphen between two known words whose joined form
is unknown is part of the spelling and stays. A word is misread if the vocabulary doesn't know it but knows it with one
confusion undone, or two where digits or signs are among its letters, or if a confused digit or sign stands between letters.

Only texts that show scanning in at least two places are treated; all others come out as they are and have no rows. Null texts
stay null and blank ones blank. Lines are split at "\\n" and counted from 1.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyword_pages import _held
from .words import Words, slices

# How scanners print characters, as (printed, meant).
CONFUSIONS = (
    ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "é"), ("@", "a"), ("f", "t"), ("c", "e"), ("cl", "d"), ("rn", "m"),
    ("li", "h"), ("vv", "w"), ("m", "rn"), ("ii", "ü"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("|", "l"), ("$", "s"), ("€", "e"),
)
SIGNS = "0159@86|$€"
SOFT = "\xad¬"
MARKS = SOFT + "‐‑-"
BROKEN = re.compile(rf"([^\W\d_][\w@]*)([{SOFT}‐‑-])\s*\Z")


def broken(line: str) -> re.Match | None:
    """The word that a line ends inside of, and the mark it is cut with."""
    x = line.rstrip()
    return BROKEN.search(x) if x and x[-1] in MARKS else None


HEAD_OF_NEXT = re.compile(r"\s*([\w@]+)")
TOKEN = re.compile(rf"[\w{re.escape('@|$€')}]+")
ODD = re.compile(r"[A-Za-zÀ-ɏ][0159@86|$€][A-Za-zÀ-ɏ]")
NUMERAL = r"[0-9lIOoSB|]{1,5}"
ROMAN = re.compile(r"(?=[ivxlcdm1])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|[xX]?[x]{0,3}|lx{0,3})(?:ix|iv|v?[i1l]{0,3})\Z")
DOMINANCE = 8  # well below it, forms a confusion apart are mostly two names
PAGE_FORMS = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"(?P<n>{NUMERAL})",
        rf"[\[(<{{—–\-·•*~]+\s*(?P<n>{NUMERAL}|[ivxlc1]+)\s*[\])>}}—–\-·•*~]+",
        rf"(?:p[a@]9?[ge9]*e?|p[a@]gina|p[áa]g|seite|s|p|pp|blatt|folio|f|nr|no)\s*\.?\s*[:#]?\s*(?P<n>{NUMERAL}|[ivxlc1]+)(?:\s*(?:of|von|de|sur|/)\s*{NUMERAL})?",
        rf"(?P<n>{NUMERAL})\s*(?:/|of|von|de|sur)\s*{NUMERAL}",
        rf"第?\s*(?P<n>{NUMERAL})\s*页",
    )
)
FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "9": "g", "@": "a", "6": "e", "é": "e", "8": "b", "f": "t", "c": "e", "|": "l"})
SENTENCE_END = re.compile(r"[.?!:;,。！？；，»”\"'’]\s*\Z")
TAIL_NUMBER = re.compile(rf"(?:\s{{2,}}|\s*[|·—–]\s*|\s+)(?:p\.?\s*|page\s+)?(?P<n>{NUMERAL}|[ivxlc]+)\s*\Z", re.IGNORECASE)
HEAD_NUMBER = re.compile(rf"\s*(?:p\.?\s*|page\s+)?(?P<n>{NUMERAL}|[ivxlc]+)(?:\s{{2,}}|\s*[|·—–]\s*|\s+)(?=\S)", re.IGNORECASE)


def _roman(x: str) -> int | None:
    x = x.lower().replace("1", "i")
    if not re.fullmatch(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", x) or not x:
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [value[c] for c in x]
    return sum(-a if any(b > a for b in n[i + 1 : i + 2]) else a for i, a in enumerate(n))


def _number(x: str) -> int | None:
    if re.fullmatch(NUMERAL, x) and any(c.isdigit() for c in x):
        return int(x.translate(str.maketrans("lIOoSB|", "1100581")))
    if re.fullmatch(r"[lI|]+", x):
        return int("1" * len(x))
    return None


def page_number(line: str) -> list[int]:
    """The numbers a line may be, if it can be a page number alone."""
    x = " ".join(line.split())
    if not x or len(x.strip("[](){}<>—–-·•*~ ")) > 30:  # two numbers of five digits and the longest words of a form have less
        return []
    out = []
    if (r := _roman(x)) is not None and (len(x) > 1 or x.lower() in "ivx"):
        out.append(r)
    for form in PAGE_FORMS:
        if m := form.fullmatch(x):
            for v in (_number(m["n"]), _roman(m["n"])):
                if v is not None:
                    out.append(v)
    return out


def fold(line: str) -> str:
    """A line with what scanners confuse made equal and its page number cut off."""
    x = TAIL_NUMBER.sub("", HEAD_NUMBER.sub("", line.strip(), count=1), count=1) or line.strip()
    x = re.sub(r"\s+", " ", x.lower().replace("cl", "d").replace("rn", "m").replace("vv", "w").replace("li", "h").replace("ii", "ü").replace("ﬁ", "fi").replace("ﬂ", "fl"))
    return x.translate(FOLD)


def _alike(a: str, b: str) -> bool:
    """Whether two folded lines differ in few characters."""
    if a == b:
        return True
    n = max(len(a), len(b))
    if abs(len(a) - len(b)) > 2 or n < 6:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= max(1, n // 8)


class Titles:
    """Folded lines, the first of each group, found again by their pieces.

    A line of m characters is kept in one piece more than there may be edits; a line alike has one of the pieces, shifted by no more than the edits.
    """

    FEW = 24  # up to so many all are compared

    def __init__(self) -> None:
        self.keys: list[str] = []
        self.pieces: dict[tuple[int, int, str], list[int]] = {}

    @staticmethod
    def cuts(m: int) -> Iterator[tuple[int, int, int]]:
        edits = max(1, (m + 2) // 8)
        for p in range(edits + 1):
            yield p, m * p // (edits + 1), m * (p + 1) // (edits + 1)

    def add(self, f: str) -> None:
        for p, lo, hi in self.cuts(len(f)):
            self.pieces.setdefault((len(f), p, f[lo:hi]), []).append(len(self.keys))
        self.keys.append(f)

    def first(self, f: str) -> int | None:
        """The first line kept that is alike."""
        if len(self.keys) <= self.FEW:
            return next((g for g, k in enumerate(self.keys) if _alike(f, k)), None)
        found = set()
        for m in range(max(0, len(f) - 2), len(f) + 3):
            edits = max(1, (m + 2) // 8)
            for p, lo, hi in self.cuts(m):
                for d in range(max(-edits, -lo), edits + 1):
                    found.update(self.pieces.get((m, p, f[lo + d : hi + d]), ()))
        return next((g for g in sorted(found) if _alike(f, self.keys[g])), None)


def alike_groups(items: list[int], folded: list[str]) -> list[list[int]]:
    """Items whose folded lines are alike the first of their group."""
    groups: list[list[int]] = []
    titles, place = Titles(), {}
    for i, f in zip(items, folded, strict=True):
        if f not in place:
            place[f] = titles.first(f)
            if place[f] is None:
                place[f] = len(groups)
                groups.append([])
                titles.add(f)
        groups[place[f]].append(i)
    return groups


class Page:
    """What each line of one text is."""

    def __init__(self, text: str, knows):
        self.lines = text.split("\n")
        self.knows = knows
        self.kinds: list[set[str]] = [set() for _ in self.lines]
        self.full = [i for i, x in enumerate(self.lines) if x.strip()]
        widths = sorted(len(self.lines[i].rstrip()) for i in self.full)
        self.width = widths[int(len(widths) * 0.9)] if widths else 0
        self._numbers()
        self._headers()
        if self._numbers_beside():
            self._headers()
        self._breaks()
        self._misread()

    def _numbers(self) -> None:
        """Page numbers: the longest chains of lines whose numbers go up by one from page to page."""
        can = [(i, n) for i in self.full for n in page_number(self.lines[i])]
        best: dict[tuple[int, int], tuple[int, tuple | None]] = {}
        longest: dict[int, tuple[int, int]] = {}  # by number: the longest chain that ends with it so far, and its line
        for i, same in itertools.groupby(can, key=lambda x: x[0]):
            now = {n: longest.get(n - 1, (0, -1)) for _, n in same}
            for n, (length, j) in now.items():
                best[i, n] = (length + 1, (j, n - 1) if length else None)
            for n, (length, _) in now.items():
                if length + 1 > longest.get(n, (0, -1))[0]:
                    longest[n] = (length + 1, i)
        chosen: dict[int, int] = {}
        explicit = re.compile(r"\s*(?:\W*p[a@]?g?e?\W|seite|s\.|\[|\(|[—–-]|第)|\s{4,}\S", re.IGNORECASE)
        for key, (length, _) in sorted(best.items(), key=lambda x: -x[1][0]):
            if length == 1 and not (explicit.match(self.lines[key[0]]) or _roman(self.lines[key[0]].strip()) and len(self.lines[key[0]].strip()) > 1):
                continue
            chain, at = [], key
            while at is not None:
                chain.append(at)
                at = best[at][1]
            if any(i in chosen for i, _ in chain):
                chain = [x for x in chain if x[0] not in chosen]
                if length > 1 and len(chain) < length:
                    continue
            chosen.update(chain)
        self.numbers = chosen
        for i in chosen:
            self.kinds[i].add("page_number")

    def _numbers_beside(self) -> bool:
        """Adds lone numbers that carry on the numbers of headers that have theirs in the same line."""
        marks = [(i, self._own_number(i)) for i in self.full if "header" in self.kinds[i]] + list(self.numbers.items())
        marks = [(i, n) for i, n in marks if n is not None]
        found = False
        for i in self.full:
            if not self.kinds[i] and i not in self.numbers:
                for n in page_number(self.lines[i]):
                    if any(n - m in (1, 2) and j < i or m - n in (1, 2) and j > i for j, m in marks):
                        self.numbers[i] = n
                        self.kinds[i].add("page_number")
                        found = True
                        break
        return found

    def _title_like(self, i: int) -> bool:
        x = self.lines[i].strip()
        words = x.split()
        return 1 <= len(words) <= 9 and len(x) <= max(0.8 * self.width, 30) and not SENTENCE_END.search(x) and not broken(x) and any(c.isalpha() for c in x) and (x[0].isupper() or not x[0].isalpha())

    def _headers(self) -> None:
        able = [i for i in self.full if i not in self.numbers and self._title_like(i)]
        groups = alike_groups(able, [fold(self.lines[i]) for i in able])
        edges = set(self.full[:1]) | set(self.full[-1:])
        order = {i: p for p, i in enumerate(self.full)}
        for i in self.numbers:
            p = order[i]
            edges |= {self.full[q] for q in (p - 1, p + 1) if 0 <= q < len(self.full)}
        for g in groups:
            apart = len(g) >= 2 and min(b - a for a, b in zip(g, g[1:], strict=False)) >= 3
            tails = [self._own_number(i) for i in g]
            rising = len(g) >= 2 and any(a is not None and b is not None and 0 < b - a <= 3 for a, b in zip(tails, tails[1:], strict=False))
            if len(g) >= 2 and (apart and any(i in edges for i in g) and self._unlike_body(g) or rising):
                for i in g:
                    self.kinds[i].add("header")
        for _ in range(2):  # a line at an edge beside furniture, though it comes once
            for i in able:
                if self.kinds[i]:
                    continue
                p = order[i]
                beside = [self.full[q] for q in (p - 1, p + 1) if 0 <= q < len(self.full)]
                if any("page_number" in self.kinds[j] for j in beside) and self._once(i, p):
                    self.kinds[i].add("header")
        if self.numbers and able and able[0] == self.full[0] and not self.kinds[able[0]] and len(self.lines[able[0]].split()) >= 2 and len(self.lines[able[0]].strip()) <= 0.75 * max(self.width, 40):
            directly = able[0] + 1 < len(self.lines) and bool(self.lines[able[0] + 1].strip())
            if directly or self._sides().get("after") or self.lines[able[0]].isupper():  # the header of the first page
                self.kinds[able[0]].add("header")
        if self.numbers and able and able[-1] == self.full[-1] != self.full[0] and not self.kinds[able[-1]] and self.lines[able[-1] - 1].strip() and self._once(able[-1], order[able[-1]]):
            self.kinds[able[-1]].add("header")  # the footer of the last page

    def _own_number(self, i: int) -> int | None:
        x = self.lines[i].strip()
        for m in (TAIL_NUMBER.search(x), HEAD_NUMBER.match(x)):
            if m:
                v = _number(m["n"])
                if v is None:
                    v = _roman(m["n"])
                if v is not None:
                    return v
        return None

    def _unlike_body(self, g: list[int]) -> bool:
        return all(len(self.lines[i].split()) <= 9 for i in g)

    def _once(self, i: int, p: int) -> bool:
        """Whether a title beside a page number is furniture and not a heading or a line of the body: it is far shorter than the
        lines of the body, though no sentence ends with it."""
        x = self.lines[i].strip()
        if len(x.split()) < 2 or len(x) > 0.75 * max(self.width, 40):
            return False
        return len(self.numbers) >= 2 or self.full[p - 1] in self.numbers and p > 0

    def _sides(self) -> dict[str, bool]:
        """On which side of page numbers headers have been found."""
        out = {}
        for p, i in enumerate(self.full):
            if "header" in self.kinds[i]:
                if p > 0 and self.full[p - 1] in self.numbers:
                    out["after"] = True
                if p + 1 < len(self.full) and self.full[p + 1] in self.numbers:
                    out["before"] = True
        return out

    def body(self) -> list[int]:
        return [i for i in self.full if not self.kinds[i] & {"header", "page_number"}]

    def _breaks(self) -> None:
        body = self.body()
        asked, found = [], []
        for a, b in zip(body, body[1:], strict=False):
            m, n = broken(self.lines[a]), HEAD_OF_NEXT.match(self.lines[b])
            if not m or not n or n[1][0].isupper() or n[1].isdigit():
                continue
            found.append((a, b, m, n))
            asked += [m[1] + n[1], m[1], n[1]]
        known = self.knows(asked)
        self.wholes = {w for _, _, m, n in found if not known[w := (m[1] + n[1]).lower()]}
        self.knows([v for w in self.wholes for v, _ in variants(w)])  # all at once: what is asked below is known then
        self.joins: dict[int, bool] = {}
        for a, b, m, n in found:
            joined, left, right = (known[x.lower()] or any(known_variant(x, self.knows)) if y else known[x.lower()] for x, y in ((m[1] + n[1], True), (m[1], False), (n[1], False)))
            soft = m[2] in SOFT
            if soft or joined or not (left and right):
                if not soft and not joined and self._compound(a, b, m, n):
                    continue
                self.kinds[a].add("broken_word")
                self.joins[a] = True

    def _compound(self, a: int, b: int, m: re.Match, n: re.Match) -> bool:
        """A hyphenated spelling cut at its hyphen, though one half is misread: both halves are known with confusions undone."""
        halves = []
        for x in (m[1], n[1]):
            halves.append(self.knows([x])[x.lower()] or any(known_variant(x, self.knows)))
        return all(halves) and min(len(m[1]), len(n[1])) >= 4

    def _misread(self) -> None:
        body = self.body()
        tokens: dict[int, list[str]] = {}
        for a in body:
            line = self.lines[a]
            if m := broken(line):
                line = line[: m.start()] + " " + ("" if "broken_word" in self.kinds[a] else m[1])
            tokens[a] = [t for t in TOKEN.findall(line)]
        after = {a: body[i + 1] for i, a in enumerate(body[:-1])}
        for a in body:
            if "broken_word" in self.kinds[a] and tokens.get(after[a]):
                tokens[after[a]] = tokens[after[a]][1:]
        known = self.knows([t for x in tokens.values() for t in x])
        unknown = {t for x in tokens.values() for t in x if not known[t.lower()]}
        bad = misread(unknown, self.knows)
        self.unknown = {t.lower() for t in unknown - bad if len(t) >= 3 and any(c.isalpha() for c in t) and "_" not in t}
        for a, x in tokens.items():
            if any(t in bad for t in x):
                self.kinds[a].add("misread")
        for a in body:  # a broken word is judged as a whole, and each line by what its half shows
            if "broken_word" in self.kinds[a]:
                m, n = broken(self.lines[a]), HEAD_OF_NEXT.match(self.lines[after[a]])
                whole = m[1] + n[1]
                if self.knows([whole])[whole.lower()]:
                    continue
                for place in places(whole, self.knows):
                    self.kinds[a if place < len(m[1]) else after[a]].add("misread")
        self.bad = bad

    def shows(self) -> int:
        """In how many places the text shows that it was scanned."""
        return sum(len(k) for k in self.kinds)


def _undone(low: str, begin: int = 0) -> list[tuple[str, int]]:
    out = []
    for printed, meant in CONFUSIONS:
        if printed in low:
            at = low.find(printed, begin)
            while at >= 0:
                out.append((low[:at] + meant + low[at + len(printed) :], at))
                at = low.find(printed, at + 1)
    return out


@lru_cache(50_000)
def _variants(low: str) -> tuple[tuple[str, int], ...]:
    return tuple(_undone(low))


@lru_cache(2_000)
def _twice(low: str) -> tuple[tuple[str, int, int], ...]:
    return tuple((v, a, b) for w, a in _variants(low) for v, b in _undone(w.lower(), a + 1))


def variants(word: str) -> tuple[tuple[str, int], ...]:
    """The word with one confusion undone, and where."""
    return _variants(word.lower())


def twice(word: str) -> tuple[tuple[str, int, int], ...]:
    """The word with two confusions undone, and where, the second behind the first."""
    return _twice(word.lower())


def known_variant(word: str, knows) -> Iterator[bool]:
    one = [v for v, _ in variants(word)]
    yield any(knows(one).values()) if one else False


def places(word: str, knows) -> list[int]:
    """Where a word is misread: places whose confusion undone, alone or with a second one, makes it known; or signs between letters."""
    one = list(variants(word))
    known = knows([v for v, _ in one])
    hit = [at for v, at in one if known[v]]
    if hit:
        return hit[:1]
    two = twice(word)
    known = knows([v for v, _, _ in two])
    for v, a, b in two:
        if known[v]:
            return [a, b]
    return odd_places(word)


def odd_places(word: str) -> list[int]:
    """Where a sign stands between letters, or at an edge of a word."""
    return [m.start() + 1 for m in ODD.finditer(word)] or ([0] if re.fullmatch(r"[0159@86$€|][a-zà-ÿ]{3,}", word) else [len(word) - 1] if re.fullmatch(r"\w*[a-zà-ÿ]{3,}[0159@86$€|]", word) and word[-1] in "@" else [])


def misread(words: set[str], knows) -> set[str]:
    """The misread ones. The variants of many words are asked for together."""
    out = set()
    able = [w for w in words if len(w) >= 3 and any(c.isalpha() for c in w) and "_" not in w]
    letters = {w for w in able if w.isalpha() and "ﬁ" not in w and "ﬂ" not in w}
    able = [w for w in able if len(w) >= 4 or w not in letters]
    for lo in range(0, len(able), 1000):
        some = able[lo : lo + 1000]
        known = knows([v for w in some for v, _ in variants(w)])
        hit = {w for w in some if any(known[v] for v, _ in variants(w))}
        rest = [w for w in some if w not in hit and w not in letters]
        known = knows([v for w in rest for v, _, _ in twice(w)])
        out |= hit | {w for w in rest if any(known[v] for v, _, _ in twice(w)) or odd_places(w)}
    return out


class Vocabulary:
    """Words by their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.known: set[int] | None = None

    def with_more(self, keys: list[int] | None) -> "Vocabulary":
        """The same with further words, by their hashes."""
        if not keys:
            return self
        more = Vocabulary(np.array(keys, np.int64).view(np.uint64))
        more.base = self
        return more

    base: "Vocabulary | None" = None

    def knows(self, words: list[str]) -> dict[str, bool]:
        if self.base is None:
            return self._knows(words)
        known = self.base._knows(words)
        return known | self._knows([w for w, x in known.items() if not x])

    def _knows(self, words: list[str]) -> dict[str, bool]:
        """For each word, lower-cased, whether the vocabulary has it; what isn't all letters and digits it doesn't have."""
        if self.known is None:
            self.known, self.seen = set(self.hashes.tolist()), {}
        low = {w.lower() for w in words}
        new = [w for w in low if w not in self.seen]
        if new:
            if len(self.seen) > 200_000:
                self.seen.clear()
                new = list(low)
            plain = [w for w in new if w.isalnum()]
            h = Words([" ".join(plain)]).h.tolist() if plain else []
            self.seen.update(dict.fromkeys(new, False))
            if len(h) == len(plain):
                self.seen.update((w, x in self.known) for w, x in zip(plain, h, strict=True))
        return {w: self.seen[w] for w in low}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if kept:
            k, c = (np.concatenate(x) for x in zip(*kept, strict=True))
            u, at = np.unique(k, return_inverse=True)
            kept.clear()
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(np.bincount(at, c).astype(np.int64))], names=["key", "n"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        n += len(texts)
        for lo, hi in slices(texts):
            words = Words(texts[lo:hi])
            kept.append(_held(words.doc, words.h))
        if sum(len(k) for k, _ in kept) > 2_000_000:
            yield from flush()
    yield from flush()
    yield pa.record_batch([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["key", "n"])


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(key, n): the number of texts that hold each word, and under null that of all texts."""
    from skein.plans.tables import written

    return written(df.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(_count_words, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))


def vocabulary(counted: DataFrame, word_share: float = 0.002) -> Vocabulary:
    """The words held by a share of ``word_share`` of the texts or more, and by three at least."""
    total = counted.where("key is null").select("n").first()
    rows = counted.where(F.col("key").isNotNull() & (F.col("n") >= max(3.0, word_share * (total[0] if total else 0)))).select("key").toArrow()
    return Vocabulary(np.asarray(rows.column("key").combine_chunks()).view(np.uint64))


def hashed(words: list[str]) -> dict[str, int]:
    """The words of letters and digits only with their hashes."""
    plain = [w for w in dict.fromkeys(words) if w.isalnum()]
    h = Words([" ".join(plain)]).h.view(np.int64).tolist() if plain else []
    return dict(zip(plain, h, strict=True)) if len(h) == len(plain) else {}


def asked(page: Page) -> set[tuple[int | None, int]]:
    """(word, key): what the full counts should be asked for: the unknown words with their variants, and joined words alone."""
    pairs = [(None, w) for w in page.wholes]
    for w in page.unknown | page.wholes:
        one = [v for v, _ in variants(w)]
        two = [v for v, _, _ in twice(w)] if not w.isalpha() else []
        pairs += [(w, v) for v in one + two]
    key = hashed([x for p in pairs for x in p if x])
    return {(key.get(w), key[v]) for w, v in pairs if v in key}


def rare_words(asks: DataFrame, counted: DataFrame) -> DataFrame:
    """(id, keys): of the words that texts ask for (id, word, key), those that count as known in the text: of joined words and of variants of what
    is no word those held by three texts, of other variants those held by ``DOMINANCE`` times as many texts as the word itself."""
    n = counted.where("key is not null")
    found = asks.distinct().join(n.where("n >= 3"), "key").join(n.select(F.col("key").alias("word"), F.col("n").alias("own")), "word", "left")
    return found.where(F.col("word").isNull() | (F.col("n") >= DOMINANCE * F.coalesce("own", F.lit(1)))).groupBy("id").agg(F.collect_set("key").alias("keys"))


CUT = re.compile(rf"(?<=[^\W\d_])[{SOFT}‐‑-]\s*\n")
LONE = re.compile(r"\n[ \t]*(?:\W{0,2}\s*(?:p|pa[gq]e|pag|pág|seite)?\.?\s*[0-9lIOS]{1,4}(?:\s*(?:of|/|von|de|sur)\s*[0-9lIOS]+)?\W{0,2}|[ivxlc]+)[ \t]*(?:\n|\Z)", re.IGNORECASE)


def could_be_scanned(text: str) -> bool:
    return CUT.search(text) is not None or LONE.search("\n" + text) is not None or len(ODD.findall(text)) >= 2


def _shows(page: Page, least: int) -> bool:
    return page.shows() >= least and sum(bool(k & {"broken_word", "misread", "page_number"}) for k in page.kinds) >= least


def _pages(texts: list[str], more: list[list[int] | None], vocab: Vocabulary, least: int) -> Iterator[tuple[int, Page]]:
    for i, (t, keys) in enumerate(zip(texts, more, strict=True)):
        if t is not None and could_be_scanned(t):
            page = Page(t, vocab.with_more(keys).knows)
            if _shows(page, least):
                yield i, page


def _line_rows(ident: str, page: Page) -> Iterator[tuple]:
    return ((ident, n, k) for n, kinds in enumerate(page.kinds, 1) for k in sorted(kinds))


def _first_look(source: DataFrame, shared, least: int) -> DataFrame:
    """(id, line_no, line_kind, word, key): the lines of scanned texts as the frequent words tell, and rows without line for what texts ask."""
    from skein.plans.tables import written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if could_be_scanned(t):
                    page = Page(t, shared.value.knows)
                    out += [(*r, None, None) for r in _line_rows(ident, page)] if _shows(page, least) else []
                    out += [(ident, None, None, w, k) for w, k in asked(page)]
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["id", "line_no", "line_kind", "word", "key"])

    return written(source.where("text is not null and id is not null").mapInArrow(run, "id string, line_no int, line_kind string, word bigint, key bigint"))


def scan_lines(df: DataFrame, id_col: str, text_col: str, word_share: float = 0.002, least: int = 2) -> DataFrame:
    """(id, line_no, line_kind): the lines of scanned texts that need repair, a row for each line and kind. Texts that rare words tell more of are
    looked at twice."""
    from skein.plans.tables import written

    counted = word_counts(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(counted, word_share))
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    first = _first_look(source, shared, least)
    rare = written(rare_words(first.where("key is not null").select("id", "word", "key"), counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keys = (c.to_pylist() for c in batch.columns)
            out = [r for i, page in _pages(texts, keys, shared.value, least) for r in _line_rows(ids[i], page)]
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["id", "line_no", "line_kind"])

    again = source.join(rare, "id").select("id", "text", "keys").mapInArrow(run, "id string, line_no int, line_kind string")
    return first.where("key is null").select("id", "line_no", "line_kind").join(rare, "id", "left_anti").unionByName(again)


def correct(word: str, knows) -> str:
    """A word with its confusions undone, in its own case; signs between letters of unknown words get their likeliest letter."""
    if knows([word])[word.lower()]:
        return word
    fixed = next((v for v, _ in variants(word) if knows([v])[v]), None)
    if fixed is None:
        fixed = next((v for v, _, _ in twice(word) if knows([v])[v]), None)
    if fixed is None:
        likely = dict(reversed(CONFUSIONS))
        fixed = re.sub(rf"(?<=[^\W\d_])[{re.escape(SIGNS)}](?=[^\W\d_])", lambda m: likely[m.group()], word.lower())
    return fixed.upper() if word.isupper() and len(word) > 1 else fixed[:1].upper() + fixed[1:] if word[:1].isupper() else fixed


def repaired(page: Page) -> str:
    """The body of a page as paragraphs: furniture gone, broken words joined, misread words corrected, lines of a paragraph joined.

    A blank line ends a paragraph, unless the page ends there and the sentence goes on.
    """
    out: list[str] = []
    ended, joined = True, False
    previous = None
    for i in page.body():
        line = page.lines[i].strip()
        if previous is not None:
            gap = range(previous + 1, i)
            furniture = any(page.kinds[j] & {"header", "page_number"} for j in gap)
            blank = any(not page.lines[j].strip() for j in gap)
            ended = blank and not (furniture and not SENTENCE_END.search(page.lines[previous].rstrip()) and not joined) and not joined
        m = broken(line)
        keep = line
        joins = page.joins.get(i, False)
        if joins and m:
            keep = line[: m.end(1)]
        if not out or ended:
            out.append(keep)
        elif joined:
            out[-1] += keep
        else:
            out[-1] += ("" if broken(out[-1]) else " ") + keep
        joined, previous = joins, i
    knows = page.knows
    fix = {t: correct(t, knows) for p in out for t in TOKEN.findall(p)}
    bad = misread({t for t in fix if not knows([t])[t.lower()]}, knows)
    return "\n\n".join(TOKEN.sub(lambda m: fix[m.group()] if m.group() in bad else m.group(), p) for p in out)


def repair(df: DataFrame, id_col: str, text_col: str, word_share: float = 0.002, least: int = 2) -> DataFrame:
    """(id, text, repaired): every text, scanned ones as continuous paragraphs and others untouched."""
    counted = word_counts(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(counted, word_share))
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rare = rare_words(_first_look(source, shared, least).where("key is not null").select("id", "word", "key"), counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = [False] * len(texts)
            for i, page in _pages(list(texts), batch.column(2).to_pylist(), shared.value, least):
                texts[i], done[i] = repaired(page), True
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(done)], names=["id", "text", "repaired"])

    return source.join(rare, "id", "left").select("id", "text", "keys").mapInArrow(run, "id string, text string, repaired boolean")
