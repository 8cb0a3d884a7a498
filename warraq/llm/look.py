"""How a text looks to a reader, whatever characters store it.

Two texts look the same when they differ only in unseen characters, width
variants, composed against decomposed accents, presentation forms, letters of
another script with the same glyph, and the amount of white space.  A different
letter, letter case, vowel mark, digit shape or punctuation mark is seen.

``LookForm`` turns a token into its canonical spelling.  The token, as stored, is
walked over a trie of the vocabulary by a weighted edit automaton whose
look-alike and ignorable moves cost nothing and whose other moves are not allowed
(a budget of zero).  Some letters look like several others (a bare upright stroke
like capital i and small l) or are letters of their own elsewhere (Armenian and
Cherokee ones like Latin ones): the vocabulary's word decides how they are read.
Tokens that the vocabulary doesn't hold are normalised by table.

Null texts have no form (``None``); empty texts have the form ``""``.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable

# Code points that print nothing.
UNSEEN = frozenset(
    [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0]
    + list(range(0x200B, 0x2010))
    + list(range(0x202A, 0x202F))
    + list(range(0x2060, 0x2070))
    + list(range(0xFE00, 0xFE10))
    + [c for c in [*range(0x00, 0x20), *range(0x7F, 0xA0)] if not chr(c).isspace()]
)

# Letters and marks of another script or block with the glyph of the one named.
SAME_GLYPH = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o",
    "‐": "-", "‑": "-",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
}

# Letters that look like several, or are letters of their own: how they are read by table, and how a word may read them.
READINGS = {
    "І": "Il", "Ι": "Il", "Ӏ": "Il", "ǀ": "lI", "ꓲ": "Il", "ⵏ": "lI", "ν": "νv", "ρ": "ρp", "ɡ": "ɡg", "օ": "օo", "ո": "ոn", "ս": "սu", "հ": "հh", "ց": "ցg",
    "Ꭺ": "ᎪA", "Ᏼ": "ᏴB", "Ꮯ": "ᏟC", "Ꭼ": "ᎬE", "Ꮋ": "ᎻH", "Ꭻ": "ᎫJ", "Ꮶ": "ᏦK", "Ꮮ": "ᏞL", "Ꮇ": "ᎷM", "Ꮲ": "ᏢP", "Ꭱ": "ᎡR", "Ꮪ": "ᏚS", "Ꭲ": "ᎢT", "Ꮩ": "ᏙV", "Ꮃ": "ᎳW", "Ꮓ": "ᏃZ",
    "ە": "ەه", "ہ": "ہه", "ھ": "ھه", "ۃ": "ۃة",
}

# Letters whose glyph depends on whether another letter follows: (before a letter, at the end).
BY_PLACE = {"ی": ("ي", "ى"), "ک": ("ك", "ک")}


def _compatible(code: int) -> str | None:
    """The plain spelling of a width variant or presentation form, else None."""
    if not (0xFB00 <= code <= 0xFB06 or 0xFB50 <= code <= 0xFDFF or 0xFE70 <= code <= 0xFEFE or 0xFF01 <= code <= 0xFFEE):
        return None
    plain = unicodedata.normalize("NFKC", chr(code))
    return plain.replace(" ", "") if plain != chr(code) else None


PLAIN = {c: p for c in [*range(0xFB00, 0xFE00), *range(0xFE70, 0xFFEF)] if (p := _compatible(c)) is not None}
TABLE = {c: "" for c in UNSEEN} | PLAIN | {ord(k): v for k, v in SAME_GLYPH.items()} | {ord(k): v[0] for k, v in READINGS.items()}
_BY_PLACE = re.compile("[" + "".join(BY_PLACE) + "]")


def _placed(text: str) -> str:
    def glyph(m: re.Match) -> str:
        at = m.end()
        while at < len(text) and unicodedata.combining(text[at]):
            at += 1
        return BY_PLACE[m.group()][0 if at < len(text) and text[at].isalpha() else 1]

    return _BY_PLACE.sub(glyph, text)


def by_table(token: str) -> str:
    """The form that the table alone gives: unseen characters dropped, variants replaced, accents composed."""
    form = unicodedata.normalize("NFC", token.translate(TABLE))
    return unicodedata.normalize("NFC", _placed(form)) if _BY_PLACE.search(form) else form


class Trie:
    """The vocabulary's words, decomposed, one node per prefix; a word's end holds (its rank, the word in the table's form)."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for rank, word in enumerate(words):
            if not word:
                continue
            node, form = self.root, by_table(word)
            for ch in unicodedata.normalize("NFD", form):
                node = node.setdefault(ch, {})
            node.setdefault("", (rank, form))  # the more frequent spelling comes first and stays


def moves(token: str) -> str:
    """The token with every character that looks like one other in its place, decomposed; those of ``READINGS`` stay."""
    out: list[str] = []
    for i, ch in enumerate(token):
        if ord(ch) in UNSEEN:
            continue
        if ch in BY_PLACE:
            rest = token[i + 1 :].translate(TABLE)
            after = next((c for c in rest if not unicodedata.combining(c)), "")
            out.append(BY_PLACE[ch][0 if after.isalpha() else 1])
        else:
            out.append(ch if ch in READINGS else PLAIN.get(ord(ch)) or SAME_GLYPH.get(ch) or ch)
    # marks on one letter may be stored in any order: canonical order
    return unicodedata.normalize("NFD", "".join(out))


class Automaton:
    """Weighted edit automaton over a trie: look-alikes and ignorables cost 0, any other edit its weight of 1.

    ``match(token)`` gives the vocabulary word reached within the budget, of the
    least cost, then of the fewest letters read otherwise than by table, then the
    most frequent.  With the budget of 0 used for looks only zero-cost moves are
    followed.
    """

    def __init__(self, trie: Trie, budget: int = 0):
        self.trie, self.budget = trie, budget

    def match(self, token: str) -> str | None:
        found = self.reached(token)
        return found[3] if found else None

    def reached(self, token: str) -> tuple[int, int, int, str] | None:
        """(cost, letters read otherwise, rank, word) of the word reached."""
        states: dict[int, tuple[dict, int, int]] = {id(self.trie.root): (self.trie.root, 0, 0)}
        for ch in moves(token):
            after: dict[int, tuple[dict, int, int]] = {}

            def reach(node: dict, cost: int, read: int, into: dict = after) -> None:
                if cost <= self.budget and (id(node) not in into or into[id(node)][1:] > (cost, read)):
                    into[id(node)] = (node, cost, read)

            for node, cost, read in states.values():
                for other, reading in enumerate(READINGS.get(ch, ch)):
                    if reading in node:
                        reach(node[reading], cost, read + (other > 0))
                if cost < self.budget:
                    reach(node, cost + 1, read)
                    for edge, child in node.items():
                        if edge and edge != ch:
                            reach(child, cost + 1, read)
            if not after:
                return None
            states = after
        ends = [(cost, read, *node[""]) for node, cost, read in states.values() if "" in node]
        return min(ends, default=None)


_PIECES = re.compile(r"(\w[\w\u00ad\u0300-\u036f\u061c\u064b-\u065f\u0670\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]*)")
#: Tokens that are their own form: printable ASCII, plain Arabic letters, digits and punctuation, single vowel marks.
_ALREADY = re.compile(r"(?:[!-~\u060c\u061b\u061f\u0621-\u063a\u0641-\u064a\u0660-\u0669\u00ab\u00bb\u2013\u2014\u2022\u25aa][\u064b-\u0650\u0652]?)*")


class LookForm(dict):
    """token -> canonical spelling, filled as tokens are met; kept below ``most`` entries (a cache, so nothing is lost)."""

    def __init__(self, words: Iterable[str] = (), most: int = 500_000):
        super().__init__()
        self.automata, self.most = [Automaton(Trie(words))], most

    def also(self, rest: list[str] | None) -> LookForm:
        """The forms of a vocabulary that goes on with rarer words."""
        if not rest:
            return self
        both = LookForm((), self.most)
        both.automata = [*self.automata, Automaton(Trie(rest))]
        return both

    def word(self, piece: str) -> str | None:
        """The vocabulary's word that a piece looks like."""
        found = [(*r[:2], n, r[3]) for n, a in enumerate(self.automata) if (r := a.reached(piece))]
        return min(found)[3] if found else None

    def __missing__(self, token: str) -> str:
        if len(self) >= self.most:
            self.clear()
        if _ALREADY.fullmatch(token):
            form = token
        else:
            # words by the automaton, the rest by table; marks may straddle the pieces, so the whole is composed once more
            parts = _PIECES.split(token)
            parts[::2] = map(by_table, parts[::2])
            parts[1::2] = [self.word(p) or by_table(p) for p in parts[1::2]]
            form = unicodedata.normalize("NFC", "".join(parts))
        self[token] = form
        return form

    def text(self, text: str | None) -> str | None:
        """The canonical form of a text: its tokens' forms, one space between them."""
        return None if text is None else " ".join(filter(None, map(self.__getitem__, text.split())))


_SEVERAL = re.compile("[" + "".join(READINGS) + "]")


def readings(token: str) -> set[str]:
    """Every way to read a token that has letters with several readings, by its pieces; empty for any other."""
    out: set[str] = set()
    if _SEVERAL.search(token):
        for piece in _PIECES.split(token)[1::2]:
            if _SEVERAL.search(piece):
                out |= {unicodedata.normalize("NFC", "".join(p)) for p in itertools.product(*(READINGS.get(ch, ch) for ch in moves(piece)))}
    return out


def asked_readings(texts: Iterable[str | None]) -> set[str]:
    """The keys of words that decide how texts look, for ``common.with_rest``."""
    return {"=" + r.casefold() for t in texts if t and _SEVERAL.search(t) for token in t.split() for r in readings(token)}


def answered_readings(word: str) -> list[str]:
    return ["=" + by_table(word).casefold()]


_FIGURES = re.compile(r"\d+(?:[./:\-,٫٬]\d+)*")


class Wording(dict):
    """token -> its part of a line's wording: the look without figures and dates, in one letter case."""

    def __init__(self, looks: LookForm | None = None, most: int = 500_000):
        super().__init__()
        self.looks, self.most = LookForm() if looks is None else looks, most

    def __missing__(self, token: str) -> str:
        if len(self) >= self.most:
            self.clear()
        self[token] = part = _FIGURES.sub("", self.looks[token]).casefold()
        return part

    def line(self, line: str) -> str:
        """The wording of a line, white space aside."""
        return "".join(map(self.__getitem__, line.split()))
