"""Problem 2: variant spellings of names typed by people.

A record is its name and its mentions, each parsed into a *form*: of a person first name, middle initials, surname and
generation; of an organisation core name, line of business and legal form. Parsing undoes what people do to names: titles and degrees,
"Last, First", swapped parts, nicknames, initials, joined words, abbreviations, transliterated letters, acronyms aside. Records with the
same forms are one *signature*, so a name that a third of all rows bear is compared once.

Candidates: MinHash banding over the padded q-grams of the different surnames and core names. As many bands are taken for a word as the collision
curve asks for to find the lowest similarity that the verifier accepts at its length. Only words filed under a common mark meet: a generation and an
initial the given names may go by. Forms with the same or near words and a mark in common are candidates.
Candidates are verified by the Monge-Elkan similarity of their parts (inner similarity: 1 - Damerau-Levenshtein distance / length),
under rules for what may not differ: generation, middle initials, line of business, legal form. An edge is strong if all parts
agree, weak if a part is missing or an initial.

Clusters: star clustering on the strong edges. The record with most strong edges among its open neighbours is a star's centre; its neighbours join the star of the centre they
are most similar to; rounds go on until all are placed. Stars joined by strong edges of half the members of the smaller are one. A
record with weak edges only joins the one star they lead to; if they lead to several and none is better by ``margin``, it stays
alone.

What the records show is learned first (:func:`learned`): which words are given names, which are no core names, and which words stand for which, as
short forms come with their names under the same surnames. The lists of this module are defaults beside that and may be emptied.

Types are folded; records of other kinds than people and organisations take no part, those without type if their name shows none.
Null and blank names count by their mentions; a record without any usable form is alone. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.plans.tables import written

from .words import mix

# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sandy xander lex sascha", "amina": "mina", "anastasia": "stasia ana nastia nastya tasia", "benedikta": "bene dikta", "charles": "charlie chuck carl",
    "chidi": "", "davor": "", "dorothea": "dora thea dot dorothy dotty", "edmund": "ed eddie ned ted", "elizabeth": "betty liz beth lizzie eliza bess", "ezekiel": "zeke",
    "francesca": "cesca fran franca", "freya": "", "gabriele": "gabe gabi gaby", "guillermo": "memo guille", "harold": "harry hal", "henrietta": "hetty etta henny", "hugo": "",
    "ingeborg": "inge", "isabella": "bella isa izzy bibi", "johannes": "hannes jo johann hans", "josephine": "josie jo fina posy", "katherine": "katie kathy kate kat kitty kay", "kenji": "ken",
    "lawrence": "larry laurie", "leila": "", "leonardo": "leo nardo", "margaret": "maggie peggy meg greta madge", "mariana": "mari", "michael": "mike mick mickey", "nadia": "",
    "nikolaus": "nick klaus niko", "octavia": "tavi", "oskar": "ozzie", "patricia": "pat patty tricia trish", "penelope": "penny nell", "priya": "", "quentin": "quin quint",
    "richard": "rick dick rich ricky", "robert": "bob bobby rob robbie bert", "rosalind": "rosie roz lindy ros rosa", "sebastian": "seb bastian", "susanna": "sue susie suzy sanna",
    "theodore": "ted theo teddy", "tobias": "toby tobi", "ulrike": "rike ulli uli", "viktor": "vic vik", "vladimir": "vlad vova volodya", "william": "bill will billy liam", "winifred": "winnie fred freddie win",
    "yolanda": "landa yola yoli", "zacharias": "zak zach zack",
}
TITLES = {"dr", "prof", "professor", "eng", "dipl", "ing", "mx", "mr", "mrs", "ms", "miss", "sir", "rev", "hon"}
DEGREES = {"phd", "md", "msc", "bsc", "ba", "ma", "mba", "llm", "jd", "esq"}
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
GENERIC = {
    "he", "she", "they", "it", "him", "her", "them", "his", "hers", "its", "their", "the author", "the speaker", "the company", "the firm", "the organisation", "the organization", "the person",
    "the team", "the client", "the office", "the group", "the institution", "this person", "the writer", "the chair", "someone", "the agency",
}
BUSINESS = {
    "manufacturing": "mfg manuf mfr", "energy": "en enrg", "freight": "frt frgt", "technologies": "tech techn technology tec", "robotics": "rob robot robo", "shipping": "shpg ship", "instruments": "instr instrs", "analytics": "anl analyt",
    "associates": "assoc assocs assn", "logistics": "log logist", "laboratories": "lab labs laboratory", "publishing": "publ pub publg", "foundation": "found fdn fndn", "optics": "opt", "engineering": "eng engr engrg", "textiles": "tex text", "institute": "inst",
    "pharmaceuticals": "pharma pharm", "consulting": "cons", "systems": "sys", "services": "svc svcs serv", "industries": "ind inds", "holdings": "hldgs", "chemicals": "chem", "media": "", "foods": "", "trading": "trdg", "insurance": "ins", "bank": "bk", "international": "intl int", "brothers": "bros",
}
MODIFIERS = {"national": "natl nat", "university": "univ uni", "valley": "vly", "united": "utd", "first": "1st", "sons": "", "partners": "ptnrs", "of": "", "company": "co"}
LEGAL = {
    "inc": "inc", "incorporated": "inc", "ltd": "ltd", "limited": "ltd", "llc": "llc", "corp": "corp", "corporation": "corp", "ag": "ag", "aktiengesellschaft": "ag", "gmbh": "gmbh", "sa": "sa", "plc": "plc", "bv": "bv", "nv": "nv",
    "spa": "spa", "srl": "srl", "kg": "kg", "se": "se", "oy": "oy", "ab": "ab", "as": "as", "llp": "llp",
}
PERSON, ORGANISATION = {"person", "per", "people", "human", "individual"}, {"organization", "organisation", "org", "company", "corporation", "institution", "firm"}

ARTICLES = {"the", "messrs", "and", "u", "und", "et", "y"}


class Lexicon:
    """What is known of words in names: given names with their short forms, lines of business and modifiers with their abbreviations.

    ``nicknames``, ``business`` and ``modifiers`` are {word: "short forms"} and may be empty. ``aliases`` are pairs (short form, given name or line) learned from the
    records, ``places`` how often a word stands first and last in people's names, and ``common`` words of many organisations, all learned.
    """

    def __init__(self, nicknames: dict[str, str] | None = None, business: dict[str, str] | None = None, modifiers: dict[str, str] | None = None, places: dict[str, tuple[int, int]] | None = None, common: set[str] = frozenset(), aliases: list[tuple[str, str, str]] = ()):
        nicknames, business, modifiers = (d if d is not None else e for d, e in ((nicknames, NICKNAMES), (business, BUSINESS), (modifiers, MODIFIERS)))
        self.places = places or {}
        self.names: dict[str, set[str]] = {k: {k} for k in nicknames}
        for k, v in nicknames.items():
            for x in v.split():
                self.names.setdefault(x, set()).add(k)
        self.lines = {x: k for k, v in business.items() for x in v.split()} | {k: k for k in business}
        self.mods = {x: k for k, v in modifiers.items() for x in v.split()} | {k: k for k in modifiers}
        listed = set(self.names)
        # a word that differs by a slip from a name ten times as frequent is that name mistyped, and stays unknown
        index: dict[str, set[str]] = {}
        for x, (first, last) in sorted(self.places.items(), key=lambda p: (-p[1][0], p[0])):
            if first > 2 * last:
                left = left_over(x, 2 if len(x) >= 8 else 1) if len(x) >= 4 else {x}
                frequent = {y for r in left for y in index.get(r, ()) if self.places[y][0] >= 10 * first}
                if x not in self.names and not any(distance(x, y, 2) <= (2 if len(x) >= 8 else 1) for y in frequent):
                    self.names[x] = {x}
                if x in self.names:
                    for r in left:
                        index.setdefault(r, set()).add(x)
        for x in common:
            if x not in self.lines and x not in self.mods and x not in LEGAL:
                self.lines[x] = x
        heads = {"p": {}, "o": {}}
        for kind, x, k in aliases:
            heads[kind].setdefault(x, []).append(k)
        for x, ks in heads["p"].items():
            ends = {e for k in ks for e in ({k} if k not in heads["p"] or k in listed else set(heads["p"][k]))}
            self.names[x] = (self.names.get(x, set()) - {x}) | {t for k in ends for t in (self.names.get(k, {k}) if k in listed else {k})}
        for x, ks in heads["o"].items():
            if x not in business:
                self.lines[x] = self.lines.get(ks[0], ks[0])
        self.full = sorted({k for v in self.names.values() for k in v})
        self._given: dict[str, frozenset[str]] = {}
        self._near: dict[str, dict[str, set[str]]] = {}
        self._told: dict[tuple[str, str], str | None] = {}

    def _within(self, kind: str, words, x: str, most: int, long: int) -> list[tuple[int, str]]:
        """(distance, word): the words of at least ``long`` letters within ``most`` edits, found by what is left when letters are left out."""
        if kind not in self._near:
            index: dict[str, set[str]] = {}
            for w in words:
                if len(w) >= 4:
                    for r in left_over(w, 2):
                        index.setdefault(r, set()).add(w)
            self._near[kind] = index
        found = {w for r in left_over(x, 2) for w in self._near[kind].get(r, ()) if len(w) >= long and abs(len(w) - len(x)) <= most}
        return sorted((d, w) for w in found if (d := distance(x, w, most)) <= most)

    def also(self, x: str) -> frozenset[str]:
        """The given names a word may stand for, typed with one slip or two at most; none if it is no given name."""
        if x not in self._given:
            out: set[str] = self.names.get(x, set())
            if not out and len(x) >= 5 and (near := self._within("full", self.full, x, 2 if len(x) >= 8 else 1, 5)):
                out = {near[0][1]}
            if not out and len(x) >= 4 and (near := [n for n in self._within("any", self.names, x, 1, 4) if n[1][0] == x[0]]):
                out = self.names[near[0][1]]
            if len(self._given) > 200_000:
                self._given.clear()
            self._given[x] = frozenset(out)
        return self._given[x]

    def given(self, x: str) -> str | None:
        """The given name a word stands for, the first if there are several."""
        return min(self.also(x), default=None)

    def _described(self, kind: str, words: dict[str, str], x: str, long: int, two: int) -> str | None:
        if x in words:
            return words[x]
        if (kind, x) not in self._told:
            near = self._within(kind, [w for w in words if words[w] == w], x, 2 if len(x) >= two else 1, long) if len(x) >= 5 else []
            if len(self._told) > 200_000:
                self._told.clear()
            self._told[kind, x] = words[near[0][1]] if near else None
        return self._told[kind, x]

    def business(self, x: str) -> str | None:
        return self._described("line", self.lines, x, 4, 7)

    def modifier(self, x: str) -> str | None:
        return self._described("mod", self.mods, x, 5, 8)


def fold(x: str) -> str:
    """Lower case without accents; the spelled-out forms of ä, å, ö and ü count as the plain letter."""
    x = unicodedata.normalize("NFKD", x.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").lower())
    x = "".join(c for c in x if not unicodedata.combining(c))
    return re.sub(r"[oau]e(?=[^\W\d_]|\b)|aa", lambda m: m.group()[0], x)


def distance(a: str, b: str, most: int = 3) -> int:
    """Edits between two words, neighbours swapped counting as one; ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def inner(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return max(0.0, 1 - distance(a, b) / max(len(a), len(b)))


def plain(x: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))


def left_over(word: str, most: int) -> set[str]:
    """What is left of a word when up to ``most`` letters are left out."""
    out = last = {word}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def organisation(text: str, lex: Lexicon | None = None) -> tuple | None:
    """("o", core, line of business, legal form, modifiers), or None if nothing of the name is left."""
    lex = lex or default()
    x = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    x = re.sub(r",[^,]*\b(?:branch|office|division)\b", " ", x, flags=re.IGNORECASE)
    x = re.sub(r"(?<![^\W_])(?:[^\W\d_]\.){2,}(?:[^\W\d_]\b\.?)?", lambda m: m.group().replace(".", "") + " ", x)
    x = x.replace("'", "").replace("’", "")
    x = re.sub(r"gesellschaft\s+mbh", "gmbh", x, flags=re.IGNORECASE)
    x = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", x)
    core, line, legal, mods, odd = [], [], None, set(), False
    tokens = re.findall(r"[^\W_]+", x)
    for raw in tokens:
        t = fold(raw)
        if t in ARTICLES:
            odd = odd or t == "messrs"
        elif t in LEGAL and (legal is None):
            legal = LEGAL[t]
        elif (b := lex.business(t)) is not None:
            line.append(b)
        elif (m := lex.modifier(t)) is not None:
            mods.add(m)
        else:
            core.append(t)
    if not core or not "".join(core).strip():
        return None
    if len(core) == 1 and len(core[0]) <= 4 and not line and not mods and text.strip(" .").replace(".", "").isupper():
        return None  # an acronym alone names nobody for sure
    mods.discard("of")
    return ("o", "".join(core), " ".join(sorted(set(line))), legal or "", " ".join(sorted(mods)), odd or bool(legal or line or mods))


def person(text: str, lex: Lexicon | None = None) -> tuple | None:
    """("p", first, middle initials, surname, generation, whether the first name is an initial, whether it is surely a person)."""
    lex = lex or default()
    given = lex.given
    x = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    x = re.sub(r"\b([MBmb])\.\s?([Ss])c\.?", r"\1\2c", x)
    x = re.sub(r"\b(ph|Ph|PH)\.\s?([dD])\.?", r"phd", x)
    x = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", x)
    sure = False
    generation = ""
    sides = []
    for side in x.split(","):
        kept = []
        for raw in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", side):
            t = fold(raw) if given(plain(raw)) is None else plain(raw)
            if t in TITLES and len(t) > 1 or t in DEGREES:
                sure = True
            elif t in GENERATIONS:
                generation, sure = GENERATIONS[t], True
            else:
                kept.append(t)
        if kept:
            sides.append(kept)
    if not sides:
        return None
    if len(sides) >= 2:
        surname, rest = sides[0], [t for s in sides[1:] for t in s]
    else:
        tokens = sides[0]
        if len(tokens) == 1:
            return None
        if len(tokens[0]) > 1 and (len(tokens[-1]) == 1 or given(tokens[-1]) and not given(tokens[0])):
            surname, rest = tokens[:1], tokens[1:]
            if len(rest) > 1 and len(tokens[-1]) == 1 and given(tokens[1]) is None and given(tokens[0]):
                surname, rest = tokens[1:2], [tokens[0], *tokens[2:]]
        else:
            surname, rest = tokens[-1:], tokens[:-1]
    last = "".join(surname)
    first = rest[0]
    initial = len(first) == 1
    full = given(first) if not initial else None
    middle = "".join(sorted({t[0] for t in rest[1:]}))
    known = full is not None
    return ("p", full or first, middle, last, generation, initial, sure or known or initial, first)


def forms(name: str | None, mentions: list[str] | None, kind: str | None, lex: Lexicon | None = None) -> list[tuple]:
    """The distinct forms of a record; none if it is neither a person nor an organisation."""
    texts = [t for t in [name, *(mentions or [])] if t and t.strip() and " ".join(t.lower().split()) not in GENERIC]
    k = (kind or "").strip().lower()
    if k and k not in PERSON | ORGANISATION:
        return []
    if not k:
        people, firms = [person(t, lex) for t in texts], [organisation(t, lex) for t in texts]
        if any(o and o[5] for o in firms) and not any(p and p[6] and not (o and o[5]) for p, o in zip(people, firms, strict=True)):
            k = "org"
        elif any(p and p[6] for p in people):
            k = "person"
        else:
            return []
    parse = person if k in PERSON else organisation
    return sorted({f for t in texts if (f := parse(t, lex))}, key=str)


def allowed(a: str, b: str) -> int:
    """How many edits two surnames or core names of the same entity may be apart."""
    return 1 if min(len(a), len(b)) < 6 else 2


def heads(form: tuple, lex: Lexicon | None = None) -> Iterator[tuple[str, str, bool]]:
    """(word, mark, asks): the part that tells entities apart, with what else two forms must share to be alike: of people the
    generation and an initial the given name may go by. Given names that nothing knows may differ in the first letter, so they also ask under
    "*", where all are filed."""
    if form[0] == "o":
        yield "o" + form[1], "", True
        return
    word, first, generation = "p" + form[3], form[7], form[4]
    known = (lex or default()).also(first)
    for x in {form[1][:1], first[:1], *(n[:1] for n in known)}:
        yield word, generation + " " + x, True
    if not form[5] and len(first) >= 3:
        yield word, generation + " *", not known


def grams(word: str) -> list[str]:
    """The padded q-grams of two letters, the two in order, so that swapped neighbours change no more of them than another letter does."""
    x = f"^{word}$"
    return list({min(x[i : i + 2], x[i + 1] + x[i]) for i in range(len(x) - 1)})


def lowest(length: int) -> float:
    """The lowest Jaccard similarity of the q-grams of words of a length that are within the edits the verifier allows: an edit changes two of them."""
    n, edits = length + 1, 1 if length < 6 else 2
    return max(1, n - 2 * edits) / (n + 2 * edits)


@lru_cache(1000)
def bands_of(length: int, recall: float) -> int:
    return bands_for(lowest(length), ROWS, recall)


def bands_for(least: float, rows: int, recall: float) -> int:
    """The least number of bands at which sets of Jaccard similarity ``least`` share one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows))


ROWS = 2  # of a band


def bands(words: list[str], recall: float, seed: int = 23) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, which words have it, their key in it) of the min-hashes of the words' q-grams."""
    sets = [grams(w) for w in words]
    if not sets:
        return
    h = np.array([int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in sets for g in x], np.uint64)
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1])).astype(np.int64)
    many = np.array([bands_of(len(w), recall) for w in words])
    rng = np.random.default_rng(seed)
    for band in range(int(many.max())):
        key = np.full(len(words), band + 1, np.uint64)
        for _ in range(ROWS):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(h * (a | np.uint64(1)) + b), at))
        yield band, np.flatnonzero(many > band), key


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean over the words of the one of their best match in the other, taken both ways and averaged."""
    one = sum(max(inner(x, y) for y in b) for x in a) / len(a)
    two = sum(max(inner(x, y) for x in a) for y in b) / len(b)
    return (one + two) / 2


def alike(a: tuple, b: tuple, lex: Lexicon | None = None) -> float:
    """The similarity of two forms; 2 more if the edge is strong, 0 if they can't be the same."""
    lex = lex or default()
    if a[0] != b[0]:
        return 0.0
    if a[0] == "p":
        if a[4] != b[4] or a[2] and b[2] and not set(a[2]) & set(b[2]):
            return 0.0
        last = inner(a[3], b[3])
        if distance(a[3], b[3]) > allowed(a[3], b[3]):
            return 0.0
        if a[5] or b[5]:
            short, long = (a, b) if a[5] else (b, a)
            names = {long[1][:1], (long[7] if not long[5] else long[1])[:1], *(n[:1] for n in lex.also(long[7]))}
            return last * 0.9 if short[1] in names else 0.0
        one, two = lex.also(a[7]), lex.also(b[7])
        first = 1.0 if a[7] == b[7] or one & two else inner(a[7], b[7]) if not one or not two else 0.0
        if first < 0.7:
            return 0.0
        score = monge_elkan([a[1] if first == 1 else a[7], a[3]], [a[1] if first == 1 else b[7], b[3]])
        return 2 + score if score >= 0.85 else 0.0
    if a[3] and b[3] and a[3] != b[3]:
        return 0.0
    if a[2] and b[2] and a[2] != b[2]:
        return 0.0
    core = inner(a[1], b[1])
    if distance(a[1], b[1]) > allowed(a[1], b[1]):
        return 0.0
    score = monge_elkan([a[1], *a[2].split()], [b[1], *b[2].split()]) if a[2] and b[2] else core * 0.9
    bonus = 0.05 * (bool(a[3]) and a[3] == b[3]) + 0.02 * (a[4] == b[4])
    if a[2] and b[2]:
        return 2 + score + bonus if score >= 0.85 else 0.0
    return score + bonus


def complete(form: tuple) -> bool:
    """Whether a form has all that tells its entity from look-alikes."""
    return not form[5] if form[0] == "p" else bool(form[2])


def verdict(one: list[tuple], two: list[tuple], lex: Lexicon | None = None) -> float:
    """The best similarity of any form of one record and any of another."""
    return max((alike(a, b, lex) for a in one for b in two), default=0.0)


def _encode(form: tuple) -> str:
    return "\x1f".join("1" if x is True else "0" if x is False else x for x in form)


def _decode(x: str) -> tuple:
    f = x.split("\x1f")
    if f[0] == "p":
        return (*f[:5], f[5] == "1", f[6] == "1", f[7])
    return (*f[:5], f[5] == "1")


_default: list[Lexicon] = []


def default() -> Lexicon:
    """The lexicon of the lists above."""
    if not _default:
        _default.append(Lexicon())
    return _default[0]


def _parse(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            ids, names, kinds, mentions = (c.to_pylist() for c in batch.columns)
            found = [(i, f) for i, n, k, m in zip(ids, names, kinds, mentions, strict=True) if (f := forms(n, m, k, lex))]
            yield pa.record_batch(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([[_encode(x) for x in f] for _, f in found], pa.list_(pa.string())), pa.array([any(complete(x) for x in f) for _, f in found], pa.bool_())],
                names=["record_id", "forms", "complete"],
            )

    return run


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    """(kind, text): the names and mentions of records that say they are people or organisations."""
    for n, k, m in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
        k = (k or "").strip().lower()
        if k in PERSON | ORGANISATION:
            for t in {t for t in [n, *(m or [])] if t and t.strip() and " ".join(t.lower().split()) not in GENERIC}:
                yield "p" if k in PERSON else "o", t


def _described(text: str) -> set[str]:
    """The words of an organisation's name but for its legal form."""
    found = {fold(raw) for raw in re.findall(r"[^\W_]+", re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text))}
    return {w for w in found if len(w) > 1 and w not in LEGAL and w not in ARTICLES}


def _beaten(shared):
    """(word, n, beaten): how many names of organisations have a word, and how many of them a rarer one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = shared.value
        for batch in batches:
            held: dict[str, list[int]] = {}
            for kind, t in _texts(batch):
                if kind == "o":
                    words = _described(t)
                    least = min((many.get(w, 0) for w in words), default=0)
                    for w in words & many.keys():
                        row = held.setdefault(w, [0, 0])
                        row[0] += 1
                        row[1] += many[w] > least
            yield pa.record_batch([pa.array(list(held), pa.string()), *(pa.array([r[j] for r in held.values()], pa.int64()) for j in range(2))], names=["word", "n", "beaten"])

    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, word, n): how often words stand first ("f") or last ("l") in people's names, and in organisations' ("o")."""
    bare = Lexicon({}, {}, {})
    for batch in batches:
        held: Counter = Counter()
        for kind, t in _texts(batch):
            if kind == "p" and (f := person(t, bare)) and not f[5]:
                held["f", f[7]] += 1
                held["l", f[3]] += 1
            elif kind == "o" and (f := organisation(t, bare)):
                held.update(("o", w) for w in _described(t))
        rows = [(k, w, n) for (k, w), n in held.items()]
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "word", "n"])


def _members(shared):
    """(family, word): given names with the surname they go with, lines of business with the core name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            rows = set()
            for kind, t in _texts(batch):
                if kind == "p" and (f := person(t, lex)) and not f[5] and len(f[7]) > 1:
                    rows.add((f"p{f[3]} {f[4]}", "p" + f[7]))
                elif kind == "o" and (f := organisation(t, lex)) and f[2]:
                    rows |= {("o" + f[1], "o" + w) for w in f[2].split()}
            rows = sorted(rows)
            yield pa.record_batch([pa.array([r[j] for r in rows], pa.string()) for j in range(2)], names=["family", "word"])

    return run


def learned(records: DataFrame, share: float = 1e-4, least: int = 4, together: int = 2, confidence: float = 0.3, nicknames: dict[str, str] | None = None, business: dict[str, str] | None = None, modifiers: dict[str, str] | None = None) -> Lexicon:
    """The lexicon of the records themselves, beside the given lists.

    Of the words that a share ``share`` of the names or more, and ``least`` names at least, have, those that stand first and seldom last are given names, so they
    tell swapped names, and those that mostly have a rarer word beside them are no core names of organisations. A word stands for a more
    frequent one if both come in families together: in ``together`` at least, and in a share ``confidence`` of those it comes in. A family
    of many different names tells less and counts the less. A family is a surname or core name; by its first three letters for ``together``, so that
    its variants count once. There are at most (words of a name) / ``share`` such words, which bounds what is collected and broadcast.
    """
    lists = {"nicknames": nicknames, "business": business, "modifiers": modifiers}
    spark = records.sparkSession
    source = records.select("record_id", "name", "entity_type", "mentions")
    counted = written(source.mapInArrow(_positions, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    total = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    bar = F.when(F.col("kind") == "o", max(least, share * total.get("o", 0))).otherwise(max(least, share * total.get("f", 0)))
    many: dict[str, dict[str, int]] = {"f": {}, "l": {}, "o": {}}
    for r in counted.where(F.col("n") >= bar).collect():
        many[r["kind"]][r["word"]] = r["n"]
    places = {w: (n, many["l"].get(w, 0)) for w, n in many["f"].items() if len(w) > 1}
    ranks = source.mapInArrow(_beaten(spark.sparkContext.broadcast(many["o"])), "word string, n bigint, beaten bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("beaten").alias("beaten"))
    common = {r["word"] for r in ranks.where(F.col("beaten") >= 0.7 * F.col("n")).collect()}
    lex = Lexicon(places=places, common=common, **lists)
    found = written(source.mapInArrow(_members(spark.sparkContext.broadcast(lex)), "family string, word string").distinct())
    near = F.substring("family", 1, 4)
    alone = found.groupBy("word").agg(F.countDistinct(near).alias("n")).where(F.col("n") >= together)
    size = found.groupBy("family").agg(F.count("*").alias("size"))
    kept = written(found.join(alone, "word").join(size, "family"))
    x, y = kept.select("family", F.col("word").alias("x"), F.col("n").alias("n_x"), (1 / F.greatest(F.lit(1), F.col("size") - 1)).alias("w")), kept.select("family", F.col("word").alias("y"), F.col("n").alias("n_y"))
    both = in_tiles(x, y, "family", "x").where((F.substring("x", 1, 1) == F.substring("y", 1, 1)) & ((F.col("n_x") < F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("x") > F.col("y"))))
    pairs = both.groupBy("x", "y", "n_x").agg(F.countDistinct(near).alias("n"), F.sum("w").alias("w")).where((F.col("n") >= together) & (F.col("w") >= 1) & (F.col("w") >= confidence * F.col("n_x")))
    best = pairs.withColumn("most", F.max("w").over(Window.partitionBy("x"))).where(F.col("w") * 2 > F.col("most"))
    rows = sorted(((r["x"][0], r["x"][1:], r["y"][1:], r["w"]) for r in best.collect()), key=lambda r: (-r[3], r))
    return Lexicon(places=places, common=common, aliases=[r[:3] for r in rows], **lists)


def in_tiles(left: DataFrame, right: DataFrame, on: str, mark: str, rows: int = 2000) -> DataFrame:
    """The join of two tables on a key; a key of more than ``rows`` rows on the left is cut into tiles by ``mark``, each joined in a task of its own."""
    hot = written(left.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(on, F.ceil(F.col("_n") / rows).cast("int").alias("_tiles")))
    tiles = F.coalesce("_tiles", F.lit(1))
    a = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(mark), tiles).cast("int")).drop("_tiles")
    b = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("_tiles")
    return a.join(b, [on, "_part"]).drop("_part")


def _heads(lex: Lexicon | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in {h for e in f for h in heads(_decode(e), lex)}]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))], names=["id", "word", "mark", "asks"])

    return run


def _bands(recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                words = [w[1:] for w in batch.column(0).to_pylist()]
                for band, who, key in bands(words, recall):
                    i = pa.array(who)
                    yield pa.record_batch([*(c.take(i) for c in batch.columns), pa.array(np.full(len(who), band, np.int32)), pa.array(key[who].view(np.int64))], names=["word", "mark", "asks", "band", "key"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [i for i, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if distance(x[1:], y[1:]) <= allowed(x[1:], y[1:])]
        yield batch.take(pa.array(keep, pa.int64()))


def candidates(signature: DataFrame, recall: float = 0.995, lex: Lexicon | None = None) -> DataFrame:
    """(a, b): the pairs of signatures (id, forms) that may be alike, a < b.

    The different words meet in bands of their min-hashes, under the marks they are filed with; those within the edits the verifier allows
    are near, a word to itself too, and forms with near words and a mark in common are candidates.
    """
    filed = written(signature.select("id", "forms").mapInArrow(_heads(lex), "id bigint, word string, mark string, asks boolean"))
    words = filed.groupBy("word", "mark").agg(F.max("asks").alias("asks"))
    banded = words.mapInArrow(_bands(recall), "word string, mark string, asks boolean, band int, key bigint").withColumn("meet", F.xxhash64("band", "key", "mark"))
    x, y = banded.where("asks").select("meet", F.col("word").alias("x"), "mark"), banded.select("meet", F.col("word").alias("y"))
    met = in_tiles(x, y, "meet", "x").where((F.col("x") != F.col("y")) & (F.substring("x", 1, 1) == F.substring("y", 1, 1)) & (F.levenshtein("x", "y", 4) >= 0)).select("x", "y", "mark").distinct()
    near = written(met.mapInArrow(_near, "x string, y string, mark string"))
    beside = near.unionByName(words.where("asks").select(F.col("word").alias("x"), F.col("word").alias("y"), "mark"))
    asking = filed.where("asks").select(F.col("id").alias("a"), F.col("word").alias("x"), "mark").join(beside, ["x", "mark"]).select("a", F.concat_ws("\x1f", "y", "mark").alias("at"))
    pairs = in_tiles(asking, filed.select(F.col("id").alias("b"), F.concat_ws("\x1f", "word", "mark").alias("at")), "at", "a").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            score = [verdict([_decode(x) for x in f], [_decode(x) for x in g], lex) for f, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = [i for i, s in enumerate(score) if s > 0]
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array([score[i] for i in keep], pa.float64())], names=["a", "b", "score"])

    return run


def stars(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(id, star): star clustering of weighted edges (a, b, score), every end placed once.

    In each round the vertices with more open neighbours than any of their open neighbours (ties: the smaller id) become centres,
    and their neighbours join the centre they are most similar to; both leave with all their edges. A vertex whose edges are all
    gone is a star of its own. The open graph is written after each round and shrinks by at least its largest stars.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    now = written(both.where("a <> b"))
    placed = None
    for _ in range(max_rounds):
        rank = now.groupBy("a").agg(F.struct(F.count("*").alias("n"), (-F.col("a")).alias("i")).alias("rank"))
        beside = now.join(rank.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max("rank").alias("most"))
        centres = rank.join(beside, "a").where(F.col("rank") > F.col("most")).select(F.col("a").alias("star"), "rank")
        joined = now.join(centres.withColumnRenamed("star", "b"), "b").groupBy("a").agg(F.max(F.struct("score", "rank", F.col("b").alias("star"))).alias("x")).select(F.col("a").alias("id"), "x.star")
        done = written(joined.unionByName(centres.select(F.col("star").alias("id"), "star")))
        placed = done if placed is None else placed.unionByName(done)
        gone = done.select("id")
        now = written(now.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"stars not settled after {max_rounds} rounds")
    alone = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct().join(placed, "id", "left_anti").withColumn("star", F.col("id"))
    return placed.unionByName(alone)


def same_entities(records: DataFrame, margin: float = 0.04, recall: float = 0.995, nicknames: dict[str, str] | None = None, business: dict[str, str] | None = None, modifiers: dict[str, str] | None = None) -> DataFrame:
    """(record_id, entity_id): every record (record_id, name, entity_type, mentions) that names a person or organisation, with the
    smallest record of its entity. The lists of short forms default to those of the module and may be empty; what the records
    show is learned in any case."""
    lex = learned(records.where("record_id is not null"), nicknames=nicknames, business=business, modifiers=modifiers)
    shared = records.sparkSession.sparkContext.broadcast(lex)
    parsed = written(records.select("record_id", "name", "entity_type", "mentions").where("record_id is not null").mapInArrow(_parse(shared), "record_id bigint, forms array<string>, complete boolean"))
    signature = written(parsed.groupBy("forms").agg(F.min("record_id").alias("id"), F.first("complete").alias("complete")))
    pairs = candidates(signature, recall, lex)
    told = pairs.join(signature.select(F.col("id").alias("a"), F.col("forms").alias("x")), "a").join(signature.select(F.col("id").alias("b"), F.col("forms").alias("y")), "b")
    edges = written(told.select("a", "b", "x", "y").mapInArrow(_verify(shared), "a bigint, b bigint, score double"))
    strong, weak = edges.where("score >= 2"), edges.where("score < 2")

    first = written(stars(strong))
    size = first.groupBy("star").agg(F.count("*").alias("n"))
    across = (
        strong.join(first.select(F.col("id").alias("a"), F.col("star").alias("s")), "a").join(first.select(F.col("id").alias("b"), F.col("star").alias("t")), "b")
        .where("s <> t").groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.countDistinct("a").alias("x"), F.countDistinct("b").alias("y"))
        .join(size.select(F.col("star").alias("s"), F.col("n").alias("m")), "s").join(size.select(F.col("star").alias("t"), "n"), "t")
        .where("greatest(x, y) * 2 >= least(m, n)")
    )
    merged = connected_components(across.select(F.col("s").alias("src"), F.col("t").alias("dst")))
    place = first.join(merged.select(F.col("node").alias("star"), "component"), "star", "left").select("id", F.coalesce("component", "star").alias("star"))
    place = written(signature.select("id", "complete").join(place, "id", "left").select("id", "complete", F.coalesce("star", "id").alias("star"), F.col("star").isNull().alias("open")))

    both = weak.unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    loose = both.join(place.where("open and not complete").select(F.col("id").alias("a")), "a").join(place.select(F.col("id").alias("b"), F.col("complete").alias("full"), "star", F.col("open").alias("lone")), "b")
    leads = loose.where("full or not lone").groupBy("a", "star").agg(F.max("score").alias("score"))
    ranked = leads.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "star"))).where("r <= 2")
    best = ranked.groupBy("a").agg(F.max_by("star", "score").alias("star"), F.max("score").alias("top"), F.min("score").alias("next"), F.count("*").alias("n"))
    taken = written(best.where((F.col("n") == 1) | (F.col("top") - F.col("next") >= margin)).select(F.col("a").alias("id"), F.col("star").alias("joins")))
    others = loose.where("not full and lone").join(leads.select("a").distinct(), "a", "left_anti").join(leads.select(F.col("a").alias("b")).distinct(), "b", "left_anti").where(F.col("score") >= 0.88)
    fellow = connected_components(others.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), "component")
    final = place.join(taken, "id", "left").join(fellow, "id", "left").select("id", F.coalesce("joins", "component", "star").alias("entity"))
    all_ = parsed.join(signature.select("forms", "id"), "forms").join(final, "id").select("record_id", "entity")
    return all_.join(all_.groupBy("entity").agg(F.min("record_id").alias("entity_id")), "entity").select("record_id", "entity_id")


def same_entity_pairs(records: DataFrame, expand_up_to: int | None = 200, **how) -> DataFrame:
    """(record_id_a, record_id_b): all pairs of records of an entity, a < b. Of an entity of more than ``expand_up_to`` records each is
    paired with the smallest only, so that rows grow in proportion to the records; None expands all, large entities in parts of 200."""
    placed = written(same_entities(records, **how))
    size = placed.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")
    placed = placed.join(size, "entity_id")
    if expand_up_to is None:
        parts = F.ceil(F.col("n") / 200).cast("int")
        a = placed.select("entity_id", F.col("record_id").alias("record_id_a"), F.pmod(F.xxhash64("record_id"), parts).cast("int").alias("part"))
        b = placed.select("entity_id", F.col("record_id").alias("record_id_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        return a.join(b, ["entity_id", "part"]).where("record_id_a < record_id_b").select("record_id_a", "record_id_b")
    small = placed.where(F.col("n") <= expand_up_to)
    a, b = small.select("entity_id", F.col("record_id").alias("record_id_a")), small.select("entity_id", F.col("record_id").alias("record_id_b"))
    large = placed.where((F.col("n") > expand_up_to) & (F.col("record_id") != F.col("entity_id")))
    return a.join(b, "entity_id").where("record_id_a < record_id_b").select("record_id_a", "record_id_b").unionByName(large.select(F.col("entity_id").alias("record_id_a"), F.col("record_id").alias("record_id_b")))
