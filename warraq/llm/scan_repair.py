"""Noise in text from scanned pages (problem 3).

Lines of a scanned item (an engine's reading of a page, or a unit) are labelled
by a hidden Markov model as head, body, break (the last line of a paragraph),
foot or page number, from layout features; words are checked against the
vocabulary, and paragraphs are put together from the labels.

1. One pass over the texts gives a compact row per line: its wording's hash (as
   printed, that is with misread words put right), a lone number if it has
   nothing else, its layout features in one code, and whether it holds a misread
   word or ends in one that goes on one, two or three lines further.  Texts
   aren't moved.
2. Lines alike on neighbouring pages are found among the wordings that the
   mergeable summaries of ``repeated_lines`` propose: of a stretch of ``STRETCH``
   pages of the document, how many have the wording.
3. Codes are grouped by item (a page, so bounded) and labelled.  The model starts
   from a prior of what heads, bodies, breaks, feet and numbers look like and is
   fitted by ``ROUNDS`` of expectation and maximization over all lines: tasks add
   up expected counts, Spark sums them to a table of fixed size.  Viterbi's
   algorithm gives the labels.
4. The label decides; exact counts only veto: a head or foot must stand on a
   quarter of the document's pages, a number must be the page's.  A broken word
   goes on in the next line that is neither.

Drafts hold the texts of units: an element takes the defects of its unit's lines
by an equi-join on (document, page, hash of the text), and its paragraphs in
the same way; one that no unit matches is checked, and put right, for itself.

Nulls: an item without text has no lines; one without a document or page has no
running lines or page numbers.  Copies of an item count once.
"""

from __future__ import annotations

import copy
import re
from collections import ChainMap
from collections.abc import Callable, Iterator, MutableMapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, arrow_map, once, sent, with_rest, written
from .look import LookForm, Wording, answered_readings, asked_readings, by_table
from .repeated_lines import hash64, repeated

#: A running line stands on this share of the document's pages, and on two at least.
RUNNING_SHARE, RUNNING_LEAST = 0.25, 2
STATES = ("head", "body", "break", "foot", "number")
#: Pages of a stretch in which a line's likes are looked for, and rounds in which the model is fitted.
STRETCH, ROUNDS = 16, 3
#: The prior counts as much as this share of all lines.
PRIOR = 0.5
#: Lines that a broken word may pass over, and one more.
REACH = 3

_VOWELS = re.compile("[\u064b-\u0652ـ]")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(r"[\W_]*(\d{1,5})(?:\s*/\s*\d{1,5})?[\W_]*")
_BREAK_MARK = re.compile(r"[-‐‑–¬\u00adـ]+$")
_UNSEEN_END = re.compile("[\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff]+$")
_CODE = re.compile(r"[A-Z]{1,5}-?\d[\dA-Z-]*|[A-Z]{1,3}")
_DASHED = re.compile(r"[-‐‑–—|]\s?\d.*[-‐‑–—|]")
_ENDS = re.compile(r"[.!?؟:؛][\])»\"']*$")
_STARTS = re.compile(r"(?:[.\-(\[]?\s?\d{1,3}\s?[.)\-\]]|[•*▪◦\-–]\s|[A-Z]{3}-\d{3}:)")
# Pairs of letters that engines take for one, or one for them.
TWO_FOR_ONE = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("nn", "m"), ("lc", "k")]


class Words:
    """What is known of words: the vocabulary, and the words within one or two misread characters of it."""

    OK, MISREAD, UNKNOWN = 0, 1, 2

    def __init__(self, words: list[str]):
        self.look = LookForm(words)
        self.known: MutableMapping[str, str] = {}  # plain -> as spelt
        self.one: MutableMapping[str, str] = {}
        self.two: MutableMapping[str, str] = {}
        for w in map(self.plain, map(self.look.__getitem__, words)):
            for i in range(len(w)):
                self.one.setdefault(w[:i] + "\0" + w[i + 1 :], w)
            if len(w) >= 6:
                for i, j in combinations(range(len(w)), 2):
                    self.two.setdefault(w[:i] + "\0" + w[i + 1 : j] + "\0" + w[j + 1 :], w)
        self.judged: dict[str, int] = {}
        for w in words:
            self.known.setdefault(self.plain(self.look[w]), w)

    def also(self, rest: list[str] | None) -> Words:
        """What is known of words with a vocabulary that goes on with rarer ones."""
        if not rest:
            return self
        more, both = Words(rest), copy.copy(self)
        both.look = self.look.also(rest)
        both.known, both.one, both.two = ChainMap(self.known, more.known), ChainMap(self.one, more.one), ChainMap(self.two, more.two)
        both.judged = {}
        return both

    def asks(self, lines: list[list[str]]) -> set[str]:
        """The keys of rarer words that bear on lines of tokens, for ``common.with_rest``."""
        wanted: set[str] = set()
        filled = [[t for t in ts if self.look[t]] for ts in lines]
        filled = [ts for ts in filled if ts]
        for i, ts in enumerate(filled):
            for token in ts:
                wanted |= self._strings(token)
            for after in filled[i + 1 : i + 1 + REACH]:
                wanted |= self._joined(ts[-1], after[0])
        return {k for w in wanted for k in deletions(w)} | asked_readings([t for ts in filled for t in ts])

    def _strings(self, token: str) -> set[str]:
        """What is looked up to judge a token."""
        form = self.look[token]
        word, bare = self.plain(self.trimmed(form)), self.plain(form)
        if word in self.known or not word:
            return set()
        at = bare.find(word)
        near = {bare[max(0, at - 1) : at + len(word)], bare[at : at + len(word) + 1]} if at >= 0 else set()
        return {word, *(p for p in re.split(r"[-–/'’|]", word) if p), *near}

    def _joined(self, raw: str, after: str) -> set[str]:
        """What is looked up to judge whether a word goes on."""
        seen = _UNSEEN_END.sub("", raw)
        mark = _BREAK_MARK.search(seen)
        head, tail = self.plain(self.trimmed(self.look[seen[: mark.start()] if mark else seen])), self.plain(self.trimmed(self.look[after]))
        return {x for x in (head, tail, head + tail) if x}

    @staticmethod
    def plain(word: str) -> str:
        return _VOWELS.sub("", word).casefold()

    def nearest(self, word: str) -> str | None:
        """The vocabulary word that ``word`` (plain) may be a misreading of."""
        n = len(word)
        for i in range(n):
            if hit := self.one.get(word[:i] + "\0" + word[i + 1 :]):
                return hit
        for a, b in TWO_FOR_ONE:
            for x, y in ((a, b), (b, a)):
                at = word.find(x)
                while at >= 0:
                    if (changed := word[:at] + y + word[at + len(x) :]) in self.known:
                        return changed
                    at = word.find(x, at + 1)
        if n >= 6:
            for i, j in combinations(range(n), 2):
                if hit := self.two.get(word[:i] + "\0" + word[i + 1 : j] + "\0" + word[j + 1 :]):
                    return hit
        return None

    @staticmethod
    def trimmed(token: str) -> str:
        """The token without marks around it."""
        a, b = 0, len(token)
        while a < b and not (token[a].isalnum()):
            a += 1
        while b > a and not (token[b - 1].isalnum() or "\u064b" <= token[b - 1] <= "\u0652"):
            b -= 1
        return token[a:b]

    def judge(self, token: str) -> int:
        """Of a canonical token: OK, MISREAD or UNKNOWN."""
        if (known := self.judged.get(token)) is None:
            if len(self.judged) > 500_000:
                self.judged.clear()
            known = self.judged[token] = self._judge(token)
        return known

    def _judge(self, token: str) -> int:
        core = self.trimmed(token)
        if not _LETTER.search(core) or _CODE.fullmatch(core):
            return self.OK
        word = self.plain(core)
        if word in self.known or len(word) == 1:
            return self.OK
        parts = [p for p in re.split(r"[-–/'’|]", word) if p]
        if len(parts) > 1 and all(p in self.known or len(p) == 1 or p.isdigit() for p in parts):
            return self.OK
        if self.nearest(word) or any(len(p) > 2 and p not in self.known and self.nearest(p) for p in parts if len(parts) > 1):
            return self.MISREAD
        bare = self.plain(token)
        at = bare.find(word)
        if at >= 0 and any(x != word and self.nearest(x) for x in (bare[max(0, at - 1) : at + len(word)], bare[at : at + len(word) + 1])):
            return self.MISREAD  # a mark may be a misread letter
        letters = [c for c in word if c.isalpha()]
        arabic = sum("\u0600" <= c <= "ۿ" for c in letters)
        mixed = 0 < arabic < len(letters) or any(c.isdigit() for c in word) or any(not ("\u0600" <= c <= "ۿ" or c < "ɐ") for c in letters)
        return self.MISREAD if mixed and len(letters) > 1 else self.UNKNOWN

    def righted(self, token: str) -> str:
        """The canonical form of a token, spelt as the nearest vocabulary word if it is misread."""
        form = self.look[token]
        if self.judge(form) != self.MISREAD:
            return form
        core = self.trimmed(form)
        near = self.nearest(self.plain(core))
        return form.replace(core, self.known.get(near, near)) if near else form

    def broken(self, raw: str, after: str) -> tuple[bool, bool, bool]:
        """Whether a line's last token (as stored) goes on in the next line's first; and which of both is misread."""
        seen = _UNSEEN_END.sub("", raw)
        mark = _BREAK_MARK.search(seen)
        head = self.plain(self.trimmed(self.look[seen[: mark.start()] if mark else seen]))
        rest = self.look[after]
        m = re.match(r"[\W_]*", rest)
        if m.end() or not head or not head[-1].isalnum() or not _LETTER.search(head):
            return False, False, False
        tail = self.plain(self.trimmed(rest))
        if not tail or not _LETTER.search(tail):
            return False, False, False
        if not mark and seen != seen.rstrip(".,;:!?؟،؛)»]"):
            return False, False, False
        apart = head in self.known and tail in self.known
        whole = head + tail
        if whole in self.known:
            return bool(mark) or not apart and len(head) > 1, False, False
        if not mark or apart and not self.look[seen].endswith(("-", "¬")):
            return False, False, False
        if near := self.nearest(whole):
            differs = next((i for i, (a, b) in enumerate(zip(whole, near)) if a != b), len(whole) - 1)
            return not apart, differs < len(head) and not apart, differs >= len(head) and not apart
        return not apart and (head not in self.known or tail not in self.known), False, False


def deletions(word: str) -> list[str]:
    """The keys that a plain word asks for: itself, what it may be a misreading of, and itself without one or two characters."""
    n = len(word)
    keys = ["=" + word]
    for a, b in TWO_FOR_ONE:
        for x, y in ((a, b), (b, a)):
            at = word.find(x)
            while at >= 0:
                keys.append("=" + word[:at] + y + word[at + len(x) :])
                at = word.find(x, at + 1)
    keys += ["1" + word[:i] + "\0" + word[i + 1 :] for i in range(n)]
    if n >= 6:
        keys += ["2" + word[:i] + "\0" + word[i + 1 : j] + "\0" + word[j + 1 :] for i, j in combinations(range(n), 2)]
    return keys


def answers(word: str) -> list[str]:
    """The keys that a rarer word answers."""
    return [*deletions(Words.plain(by_table(word))), *answered_readings(word)]


def with_words(items: DataFrame, vocabulary: Lexicon | list[str]) -> DataFrame:
    """Items (kind, item_id, lines) with the rarer words that bear on their lines."""
    own = sent(vocabulary)

    def asks():
        words = once(Words, own)
        return lambda c: (words.asks([x.split() for x in lines or () if x]) for lines in c["lines"])

    return with_rest(items, ["kind", "item_id"], vocabulary, asks, answers)


LINES = "kind string, item_id long, source string, page long, line_no int, wording long, number int, code int, bits int"
# Bits of a line: what it is found to have, then a bit a line further for where its last word goes on.
RUNNING, PAGED, MISREAD, STARTS, BROKEN = 1, 2, 4, 8, 16
# Bits of a decision, above the state.
STATE, HEAD, COUNTED, GOES_ON = 7, 8, 16, 32
_RULES = re.compile(r"[|·•—]|\s[-–]\s|^[-–]")


def layout(texts: list[str], forms: list[str]) -> list[int]:
    """The code of each filled line's layout, all features of ``FEATURES`` but ``alike`` (0)."""
    n = len(forms)
    usual = float(np.median([len(t) for t in texts])) if n else 0.0
    out = []
    for i, (text, form) in enumerate(zip(texts, forms)):
        long_ = len(text) / usual if usual else 1.0
        figures = sum(c.isdigit() for c in form)
        share = figures / max(1, len(form) - form.count(" "))
        values = (
            min(i, 3), min(n - 1 - i, 3), 0 if long_ < 0.35 else 1 if long_ < 0.7 else 2 if long_ < 1.15 else 3,
            4 if not _LETTER.search(form) else 0 if not figures else 1 if share < 0.25 else 2 if share < 0.6 else 3,
            0 if not _ENDS.search(form) else 2 if form.rstrip("])»\"'")[-1] in "?؟!" else 1, 1 if _STARTS.match(form) else 2 if form[:1].islower() else 0, bool(_RULES.search(form)), text[:1].isspace(),
            0 if not i else 1 if _ENDS.search(forms[i - 1]) else 3 if _BREAK_MARK.search(forms[i - 1]) else 2,
        )
        out.append(int(sum(v * p for v, p in zip(values, PLACES))))
    return out


def read_lines(words: Words, wording: Wording, lines: list[str | None]) -> list[tuple]:
    """Per filled line (no, wording, number, code, bits) of an item."""
    numbered = [(no, x) for no, x in enumerate(lines, 1) if x]
    tokens = [x.split() for _, x in numbered]
    forms = [[words.look[t] for t in ts] for ts in tokens]
    filled = [i for i, f in enumerate(forms) if any(f)]
    numbered, tokens, forms = ([x[i] for i in filled] for x in (numbered, tokens, forms))
    bad = [{k for k, f in enumerate(fs) if words.judge(f) == Words.MISREAD} for fs in forms]
    printed = [wording.line(" ".join(words.righted(t) if k in b else t for k, t in enumerate(ts)) if b else x) for (_, x), ts, b in zip(numbered, tokens, bad)]
    broken = [0] * len(forms)
    for i in range(len(forms)):
        for step in range(1, REACH + 1):
            if i + step < len(forms):
                is_broken, first, second = words.broken(tokens[i][-1], tokens[i + step][0])
                if is_broken:
                    broken[i] |= BROKEN << step - 1
                    if step == 1:
                        # the pieces are judged as one word
                        bad[i].discard(len(tokens[i]) - 1)
                        bad[i + 1].discard(0)
                        bad[i] |= {len(tokens[i]) - 1} if first else set()
                        bad[i + 1] |= {0} if second else set()
    shown = [" ".join(filter(None, f)) for f in forms]
    codes = layout([x for _, x in numbered], shown)
    out = []
    for i, (no, _) in enumerate(numbered):
        lettered = bool(_LETTER.search(shown[i]))
        number = None if lettered else _NUMBER.fullmatch(shown[i])
        w = printed[i]
        out.append((no, hash64(w) if lettered and _LETTER.search(w) else None, int(number.group(1)) if number else None, codes[i], broken[i] | (STARTS if _STARTS.match(shown[i]) else 0) | (MISREAD if bad[i] else 0)))
    return out


def line_rows(items: DataFrame, vocabulary: Lexicon | list[str]) -> DataFrame:
    """A compact row per line of items (kind, item_id, source, page, lines)."""
    names = [c.split()[0] for c in LINES.split(", ")]
    own = sent(vocabulary)

    def start():
        top = once(Words, own)
        usual = Wording(top.look)

        def work(c: dict) -> dict:
            out: list[list] = [[] for _ in names]
            for kind, item, source, page, lines, rest in zip(*(c[k] for k in ("kind", "item_id", "source", "page", "lines", "rest_words"))):
                words = top.also(rest)
                wording = Wording(words.look) if rest else usual
                for row in read_lines(words, wording, lines or []):
                    for put, value in zip(out, (kind, item, source, page, *row)):
                        put.append(value)
            return dict(zip(names, out))

        return work

    return arrow_map(with_words(items.select("kind", "item_id", "source", "page", "lines"), vocabulary), start, LINES)


# ---------------------------------------------------------------- the labels

# The prior. Of each feature, how likely its values are in each state, and what follows what.
FEATURES = {
    # lines from the top: first, second, third, later
    "top": {"head": [50, 20, 10, 20], "body": [10, 12, 13, 65], "break": [5, 10, 15, 70], "foot": [4, 6, 10, 80], "number": [25, 10, 5, 60]},
    # lines from the bottom: last, last but one, last but two, earlier
    "bottom": {"head": [5, 5, 10, 80], "body": [8, 12, 13, 67], "break": [30, 15, 10, 45], "foot": [40, 25, 10, 25], "number": [55, 20, 10, 15]},
    # length against the item's usual line: under 0.35, under 0.7, under 1.15, longer
    "length": {"head": [35, 35, 20, 10], "body": [2, 8, 60, 30], "break": [25, 30, 30, 15], "foot": [35, 35, 20, 10], "number": [97, 2, 0.5, 0.5]},
    # figures: none, under a quarter of the characters, under 0.6, more, no letter at all
    "figures": {"head": [60, 30, 7, 2, 1], "body": [65, 30, 3, 1, 1], "break": [65, 30, 3, 1, 1], "foot": [40, 40, 15, 3, 2], "number": [0.5, 0.5, 1, 1, 97]},
    # an end mark: none, one of statements, one of questions and calls
    "ends": {"head": [90, 3, 7], "body": [85, 14, 1], "break": [20, 78, 2], "foot": [90, 3, 7], "number": [95, 4, 1]},
    # first: anything else, a clause number or bullet, a small letter
    "starts": {"head": [95, 3, 2], "body": [60, 12, 28], "break": [60, 12, 28], "foot": [95, 3, 2], "number": [80, 18, 2]},
    # rules, dots or dashes between parts: no, yes
    "rules": {"head": [60, 40], "body": [96, 4], "break": [96, 4], "foot": [70, 30], "number": [70, 30]},
    # indented: no, yes
    "indent": {"head": [80, 20], "body": [90, 10], "break": [95, 5], "foot": [80, 20], "number": [60, 40]},
    # the line before: none, ends, doesn't, ends in a broken word
    "before": {"head": [60, 20, 15, 5], "body": [10, 25, 55, 10], "break": [5, 20, 65, 10], "foot": [5, 60, 30, 5], "number": [20, 45, 30, 5]},
    # alike on pages: none, on several of the document, on a quarter of those nearby
    "alike": {"head": [5, 15, 80], "body": [97, 2, 1], "break": [97, 2, 1], "foot": [5, 15, 80], "number": [98, 1, 1]},
}
# The prior of the first line's state, and of the state after each.
FIRST = {"head": 35, "body": 45, "break": 10, "foot": 2, "number": 8}
AFTER = {
    "head": [30, 60, 5, 2, 3], "body": [2, 70, 20, 6, 2], "break": [3, 70, 12, 10, 5], "foot": [5, 25, 5, 40, 25], "number": [30, 30, 5, 30, 5],
}
SIZES = [len(v["head"]) for v in FEATURES.values()]
#: What each feature's value counts in a line's code (mixed radix, the first feature lowest).
PLACES = [int(np.prod(SIZES[:i])) for i in range(len(SIZES))]
CODES = int(np.prod(SIZES))


def _shares(m: np.ndarray) -> np.ndarray:
    return m / m.sum(-1, keepdims=True)


def prior() -> np.ndarray:
    """The prior as counts of one line: starts, transitions and values of the features by state, in one row."""
    first, after = _shares(np.array([FIRST[s] for s in STATES], float)), _shares(np.array([AFTER[s] for s in STATES], float))
    seen = [_shares(np.array([v[s] for s in STATES], float)) for v in FEATURES.values()]
    return np.concatenate([first, after.ravel() / len(STATES), *(m.ravel() / len(STATES) for m in seen)])


class Model:
    """A hidden Markov model whose emissions are the product of the features' probabilities, from counts in ``prior``'s order."""

    def __init__(self, counts: np.ndarray):
        k = len(STATES)
        counts = counts + 1e-9
        self.start, self.move = _shares(counts[:k]), _shares(counts[k : k + k * k].reshape(k, k))
        at, digits = k + k * k, np.arange(CODES)
        self.emit = np.ones((CODES, k))
        for size, place in zip(SIZES, PLACES):
            self.emit *= _shares(counts[at : at + k * size].reshape(k, size)).T[digits // place % size]
            at += k * size

    @staticmethod
    def padded(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Items' codes in one array, and their lengths."""
        sizes = np.array([len(x) for x in items])
        codes = np.zeros((len(items), sizes.max()), np.int64)
        codes[np.arange(sizes.max())[None, :] < sizes[:, None]] = np.concatenate(items)
        return codes, sizes

    def expected(self, items: list[np.ndarray]) -> np.ndarray:
        """The expected counts of items (forward and backward sums), in ``prior``'s order."""
        codes, sizes = self.padded(items)
        n, longest, k = *codes.shape, len(STATES)
        emit = self.emit[codes]
        emit /= emit.sum(2, keepdims=True)
        there = np.arange(longest)[None, :] < sizes[:, None]
        forward, backward, scale = np.zeros((longest, n, k)), np.ones((longest, n, k)), np.ones((longest, n))
        for t in range(longest):
            at = (self.start if t == 0 else forward[t - 1] @ self.move) * emit[:, t]
            scale[t] = np.where(there[:, t], at.sum(1), 1.0)
            forward[t] = at / scale[t][:, None]
        for t in range(longest - 2, -1, -1):
            at = (backward[t + 1] * emit[:, t + 1]) @ self.move.T / scale[t + 1][:, None]
            backward[t] = np.where(there[:, t + 1, None], at, 1.0)
        state = forward * backward
        state /= state.sum(2, keepdims=True)
        move = np.zeros((k, k))
        for t in range(longest - 1):
            on = there[:, t + 1]
            move += forward[t][on].T @ (backward[t + 1][on] * emit[on, t + 1] / scale[t + 1][on, None])
        move *= self.move
        flat, weight = codes[there], state.transpose(1, 0, 2)[there]
        seen = []
        for size, place in zip(SIZES, PLACES):
            value = flat // place % size
            seen.append(np.array([np.bincount(value, weight[:, j], size) for j in range(k)]).ravel())
        return np.concatenate([state[0].sum(0), move.ravel(), *seen])

    def label(self, items: list[np.ndarray]) -> list[np.ndarray]:
        """The most likely states of each item's lines (Viterbi)."""
        codes, sizes = self.padded(items)
        n, longest = codes.shape
        emit, move = np.log(self.emit + 1e-300)[codes], np.log(self.move + 1e-300)
        best, back = np.log(self.start + 1e-300) + emit[:, 0], np.zeros((longest, n, len(STATES)), np.int8)
        ends = np.where(sizes == 1, best.argmax(1), 0)
        for t in range(1, longest):
            step = best[:, :, None] + move[None]
            back[t] = step.argmax(1)
            best = step.max(1) + emit[:, t]
            ends = np.where(sizes == t + 1, best.argmax(1), ends)
        states = np.zeros((n, longest), np.int8)
        at = ends
        for t in range(longest - 1, -1, -1):
            at = np.where(sizes - 1 == t, ends, at)
            states[:, t] = at
            at = back[t][np.arange(n), at]
        return [s[:size] for s, size in zip(states, sizes)]


#: Lines that are labelled at once.
AT_ONCE = 20_000


def _in_turns(items: list[np.ndarray]):
    """Places of items (shortest first) of about ``AT_ONCE`` padded lines together."""
    order = sorted(range(len(items)), key=lambda i: len(items[i]))
    turn: list[int] = []
    for i in order:
        if not len(items[i]):
            continue
        if turn and (len(turn) + 1) * len(items[i]) > AT_ONCE:
            yield turn
            turn = []
        turn.append(i)
    if turn:
        yield turn


def _codes(column) -> list[np.ndarray]:
    """The arrays of a column of lists."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def fitted(codes: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The model's counts after expectation and maximization over all items' codes (a column of arrays)."""
    counts = prior()
    for _ in range(rounds):

        def run(batches, now=counts):
            model, total = Model(now), np.zeros(len(now))
            for b in batches:
                items = _codes(b.column(0))
                for turn in _in_turns(items):
                    total += model.expected([items[i] for i in turn])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "n"])

        sums = codes.mapInArrow(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()  # a fixed number of rows
        seen = np.zeros(len(counts))
        for r in sums:
            seen[r.i] = r.n
        lines = seen[len(STATES) * (1 + len(STATES)) :][: len(STATES) * SIZES[0]].sum()
        if not lines:
            break
        counts = seen + prior() * PRIOR * lines
    return counts


def labelled(items: DataFrame, vocabulary: Lexicon | list[str]) -> DataFrame:
    """(kind, item_id, source, page, lines, decided): the filled lines of each item, and what is decided of each."""
    rows = written(line_rows(items, vocabulary))  # read many times: its own plan would be part of each reader's
    pages = items.select("source", "page").where("page is not null and source is not null")
    lettered = rows.where("wording is not null and source is not null").select("kind", "source", "page", "item_id", "line_no", "wording")
    near, running = alike(lettered, pages)
    numbers = rows.where("number is not null and source is not null and page is not null").select("kind", "item_id", "line_no", "source", "page", (F.col("page") - F.col("number")).alias("off"))
    offsets = numbers.groupBy("source", "off").agg(F.count_distinct("page").alias("n"))
    usual = offsets.groupBy("source").agg(F.max_by("off", F.struct("n", -F.abs("off"))).alias("usual"), F.max("n").alias("n"))
    paged = numbers.join(usual, "source").where("(n > 1 and off = usual) or (n = 1 and off between 0 and 5)").select("kind", "item_id", "line_no", F.lit(0).alias("alike"), F.lit(False).alias("running"), F.lit(True).alias("paged"))
    likes = near.select("kind", "item_id", "line_no", "alike", F.lit(False).alias("running"), F.lit(False).alias("paged"))
    flags = likes.unionByName(running.select("kind", "item_id", "line_no", F.lit(0).alias("alike"), F.lit(True).alias("running"), F.lit(False).alias("paged"))).unionByName(paged)
    flags = flags.groupBy("kind", "item_id", "line_no").agg(F.max("alike").alias("alike"), F.max("running").alias("running"), F.max("paged").alias("paged"))
    full = rows.join(flags, ["kind", "item_id", "line_no"], "left").fillna(False, ["running", "paged"])
    full = full.withColumn("code", F.col("code") + F.coalesce("alike", F.lit(0)) * PLACES[-1])
    full = full.withColumn("bits", F.col("bits") + F.when(F.col("running"), RUNNING).otherwise(0) + F.when(F.col("paged"), PAGED).otherwise(0))
    # a copy of an item gives the same rows, which a set takes once: texts needn't be shuffled to drop copies
    line = F.struct("line_no", "wording", "number", "code", "bits")
    grouped = full.groupBy("kind", "item_id").agg(F.first("source").alias("source"), F.first("page").alias("page"), F.array_sort(F.collect_set(line)).alias("lines"))
    grouped = written(grouped)
    counts = fitted(grouped.select("lines.code"))

    def decide(codes: pa.Array, bits: pa.Array) -> pa.Array:
        own = _codes(codes)
        made: list = [np.zeros(0, np.int8)] * len(own)
        model = Model(counts)
        for turn in _in_turns(own):
            for i, s in zip(turn, model.label([own[i] for i in turn])):
                made[i] = s
        sizes = np.array([len(x) for x in own])
        out = decisions(np.concatenate(made), bits.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(own)), sizes)) if len(own) else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out, pa.int32()))

    return grouped.withColumn("decided", F.arrow_udf(decide, "array<int>")("lines.code", "lines.bits"))


def decisions(states: np.ndarray, bits: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Of lines in order, with their items: the state, whether the exact counts leave a head, foot or number, and whether the last word goes on."""
    head = ((states == STATES.index("head")) | (states == STATES.index("foot"))) & (bits & RUNNING > 0)
    counted = (states == STATES.index("number")) & (bits & PAGED > 0)
    noise, goes_on = head | counted, np.zeros(len(states), bool)
    for step in range(REACH, 0, -1):
        # past a line that is noise a word goes on in the next
        after = np.zeros(len(states), bool)
        after[:-step] = noise[step:] & (item[step:] == item[:-step])
        goes_on = np.where(after, goes_on, bits & (BROKEN << step - 1) > 0)
    return (states + HEAD * head + COUNTED * counted + GOES_ON * goes_on).astype(np.int32)


def alike(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (kind, item_id, line_no, alike) whose wording stands on other pages too, and those that stand on a quarter of all pages.

    Only wordings that the summaries propose, which all stand more than once, are looked at.  A stretch of a document's pages is a key of its own, so a
    document with a third of all rows is spread.
    """
    running, _, proposed = repeated(lines, pages, RUNNING_SHARE, RUNNING_LEAST, key=("source",))
    stretch = F.floor(F.col("page") / STRETCH).alias("stretch")
    own = proposed.where("page is not null").select("kind", "item_id", "line_no", "source", "wording", "page", stretch)
    there = own.groupBy("source", "wording", "stretch").agg(F.count_distinct("page").alias("n"))
    all_ = pages.groupBy("source", stretch).agg(F.count_distinct("page").alias("n_pages"))
    dense = (F.col("n") > 1) & (F.col("n") >= RUNNING_SHARE * F.col("n_pages"))
    near = there.join(all_, ["source", "stretch"]).select("source", "wording", "stretch", F.when(dense, 2).otherwise(1).alias("alike"))
    return own.join(near, ["source", "wording", "stretch"]).select("kind", "item_id", "line_no", "alike"), running


def has(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(F.lit(bit)) > 0


def line_defects(labels: DataFrame) -> DataFrame:
    """(kind, item_id, line_no, defect) of labelled items."""

    def of(x: Column, d: Column) -> Column:
        found = (F.when(has(d, GOES_ON), "broken_word"), F.when(has(x["bits"], MISREAD), "misread"), F.when(has(d, HEAD), "running_line"), F.when(has(d, COUNTED), "page_number"))
        return F.struct(x["line_no"].alias("line_no"), F.array_compact(F.array(*found)).alias("defects"))

    lines = labels.select("kind", "item_id", F.explode(F.zip_with("lines", "decided", of)).alias("x"))
    return lines.select("kind", "item_id", "x.line_no", F.explode("x.defects").alias("defect"))


def unit_items(units: DataFrame) -> DataFrame:
    """Units that were read from scans."""
    u = units.where(F.col("extraction_method") == "ocr")
    return u.select(F.lit("unit").alias("kind"), F.col("unit_id").cast("long").alias("item_id"), F.col("doc_id").cast("string").alias("source"), F.col("page").cast("long").alias("page"), "lines")


def reading_items(readings: DataFrame) -> DataFrame:
    """Pages as engines read them."""
    r = readings.where("result.text is not null")
    lines = F.split("result.text", "\n")
    return r.select(F.lit("reading").alias("kind"), F.col("reading_id").cast("long").alias("item_id"), F.col("doc_id").cast("string").alias("source"), F.col("page").cast("long").alias("page"), lines.alias("lines"))


def document_noise(labels: DataFrame) -> DataFrame:
    """(source, wordings, offset): the wordings of a document's running lines, and what its counted pages are ahead of its printed ones."""
    x = labels.where("source is not null").select("source", "page", F.explode(F.arrays_zip("lines", "decided")).alias("x"))
    d = F.col("x.decided")
    found = x.where(has(d, HEAD | COUNTED)).groupBy("source")
    return found.agg(F.collect_set(F.when(has(d, HEAD), F.col("x.lines.wording"))).alias("wordings"), F.mode(F.when(has(d, COUNTED), F.col("page") - F.col("x.lines.number")), True).alias("offset"))


class Element:
    """A draft's element whose lines aren't known: which of its tokens are noise.

    A running line is a stretch of tokens with the wording of one of the document's; one of a single word counts at the
    element's ends only.  A number is the page's if it is the page's and has dashes around it, stands beside a running line or
    after the last sentence, or is all there is.
    """

    #: Most tokens of a running line.
    LONGEST = 40

    def __init__(self, words: Words, wording: Wording, text: str, page: int | None, wordings: list[int], offset: int | None):
        self.words, self.tokens = words, text.split()
        self.forms = [words.look[t] for t in self.tokens]
        n = len(self.tokens)
        dropped = [False] * n
        running = set(wordings)
        parts = [wording[t] for t in self.tokens] if running else []
        i = 0
        while running and i < n:
            stop, joined = 0, ""
            for j in range(i, min(n, i + self.LONGEST) if parts[i] else i):
                joined += parts[j]
                if parts[j] and hash64(joined) in running and (j > i or i == 0 or j == n - 1):
                    stop = j + 1
            dropped[i:stop] = [True] * (stop - i if stop else 0)
            i = max(stop, i + 1)
        self.running = any(dropped)
        self.numbered = False
        heads = list(dropped)
        for i in range(n if page is not None and offset is not None else 0):
            for j in (i + 3, i + 2, i + 1):
                if j > n or any(dropped[i:j]):
                    continue
                shown = " ".join(self.forms[i:j]).strip()
                m = _NUMBER.fullmatch(shown)
                if not m or int(m.group(1)) != page - offset:
                    continue
                beside = i > 0 and heads[i - 1] or j < n and heads[j]
                if _DASHED.fullmatch(shown) or beside or i == 0 and j == n or j == n and _ENDS.search(self.forms[i - 1]):
                    dropped[i:j] = [True] * (j - i)
                    self.numbered = True
                    break
        self.kept = [i for i in range(n) if not dropped[i]]
        self.bad = {i for i, f in enumerate(self.forms) if words.judge(f) == Words.MISREAD}
        self.glued = set()
        for a, b in zip(self.kept, self.kept[1:]):
            is_broken, first, second = words.broken(self.tokens[a], self.tokens[b])
            if is_broken:
                self.glued.add(a)
                # the pieces are judged as one word
                self.bad -= {a, b}
                self.bad |= ({a} if first else set()) | ({b} if second else set())

    def defects(self) -> list[str]:
        found = {"broken_word": self.glued, "misread": self.bad, "page_number": self.numbered, "running_line": self.running}
        return [k for k, v in found.items() if v]

    def put_right(self) -> str:
        out, before = [], ""
        for i in self.kept:
            before += self.forms[i]
            if i in self.glued:
                before = _BREAK_MARK.sub("", _UNSEEN_END.sub("", before))
            else:
                out.append(self.words.righted(before))
                before = ""
        return " ".join(filter(None, out))


def _read_elements(alone: DataFrame, noise: DataFrame, vocabulary: Lexicon | list[str], name: str, kind: str, of) -> DataFrame:
    """(item_id, line_no, name): ``of`` each element that no unit accounts for."""

    own = sent(vocabulary)

    def elements_of(words: Words, c: dict) -> Iterator[Element]:
        usual = Wording(words.look)
        for t, p, w, o, rest in zip(c["text"], c["page"], c["wordings"], c["offset"], c.get("rest_words") or [None] * len(c["text"])):
            known = words.also(rest)
            yield Element(known, Wording(known.look) if rest else usual, t, p, w or [], o)

    def asks():
        words = once(Words, own)

        def ask(c: dict):
            for e in elements_of(words, c):
                kept = [e.tokens[i] for i in e.kept]
                # every kept token beside the next, as if each stood on a line of its own
                yield words.asks([[t] for t in kept]) | words.asks([e.tokens])

        return ask

    def start():
        words = once(Words, own)

        def work(c: dict) -> dict:
            made = list(map(of, elements_of(words, c)))
            return {"item_id": c["item_id"], "line_no": c["line_no"], name: made}

        return work

    both = alone.join(noise, "source", "left").select("item_id", "line_no", "page", "text", "wordings", "offset")
    both = with_rest(both, ["item_id", "line_no"], vocabulary, asks, answers)
    return arrow_map(both, start, f"item_id long, line_no int, {name} {kind}")


def element_defects(alone: DataFrame, noise: DataFrame, vocabulary: Lexicon | list[str]) -> DataFrame:
    """(item_id, line_no, defect) of draft elements that no unit accounts for, each checked as one line."""
    made = _read_elements(alone, noise, vocabulary, "defects", "array<string>", Element.defects)
    return made.select("item_id", "line_no", F.explode("defects").alias("defect"))


def elements(units: DataFrame, readings: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The drafts' elements of scanned documents: all, those with the unit they were made of, and those that no unit accounts for.

    All: item_id, line_no (null in a draft without elements), source, page, text.  Matched: item_id, line_no, unit_id; an
    element has as many rows as the page has units of its text.  Alone: as all, without null texts.
    """
    ocr = units.where(F.col("extraction_method") == "ocr")
    scanned = ocr.select(F.col("doc_id").cast("string").alias("source")).union(readings.select(F.col("doc_id").cast("string"))).distinct()
    parts = drafts.select(F.col("draft_id").cast("long").alias("item_id"), F.col("doc_id").cast("string").alias("source"), F.col("page").cast("long").alias("page"), F.posexplode_outer("texts").alias("i", "text"))
    parts = parts.join(scanned, "source", "left_semi").select("item_id", (F.col("i") + 1).alias("line_no"), "source", "page", "text")
    held = {"held": F.xxhash64("text"), "size": F.length("text")}
    of = ocr.select(F.col("unit_id").cast("long").alias("unit_id"), F.col("doc_id").cast("string").alias("source"), F.col("page").cast("long").alias("page"), *(c.alias(k) for k, c in held.items())).dropDuplicates(["unit_id"])
    key = ["source", "page", *held]
    keyed = parts.where("text is not null").withColumns(held)
    matched = keyed.select("item_id", "line_no", *key).join(of, key).select("item_id", "line_no", "unit_id")
    return parts, matched, keyed.join(of.select(key).distinct(), key, "left_anti").drop(*held)


def find(units: DataFrame, readings: DataFrame, drafts: DataFrame, vocabulary: Lexicon | list[str]) -> DataFrame:
    """(kind, item_id, line_no, defect) over readings, scanned units and the drafts made of them."""
    items = unit_items(units).unionByName(reading_items(readings))
    labels = written(labelled(items, vocabulary))
    lines = line_defects(labels)
    _, matched, alone = elements(units, readings, drafts)
    by_unit = lines.where(F.col("kind") == "unit").select(F.col("item_id").alias("unit_id"), "defect").distinct()
    from_units = matched.join(by_unit, "unit_id").select("item_id", "line_no", "defect")
    of_drafts = from_units.unionByName(element_defects(alone, document_noise(labels), vocabulary)).distinct()
    return lines.unionByName(of_drafts.select(F.lit("draft").alias("kind"), "item_id", "line_no", "defect")).distinct()


def paragraphs(items: DataFrame, vocabulary: Lexicon | list[str], labels: DataFrame | None = None) -> DataFrame:
    """(kind, item_id, paragraphs, text): running lines and page numbers dropped, broken words joined, misread words put right.

    A misread word becomes the vocabulary word nearest to it, in the letter case that the vocabulary has.
    ``labels`` are the items' if they have been labelled.
    """
    labels = labelled(items, vocabulary) if labels is None else labels
    labels = labels.select("kind", "item_id", F.col("lines.line_no").alias("nos"), F.col("lines.bits").alias("bits"), "decided")
    both = with_words(items.select("kind", "item_id", "lines").dropDuplicates(["kind", "item_id"]), vocabulary).join(labels, ["kind", "item_id"], "left")
    own = sent(vocabulary)

    def start():
        top = once(Words, own)

        def join(right: Callable[[str], str], kept: list[tuple[str, int, int]]) -> list[str]:
            out: list[str] = []
            open_, glue = False, False
            for text, bits, decided in kept:
                tokens = [right(t) for t in text.split()]
                if not any(tokens):
                    continue
                if not open_ or (bits & STARTS and not glue):
                    out.append("")
                if glue and out[-1]:
                    first = tokens.pop(0)
                    out[-1] = _BREAK_MARK.sub("", out[-1]) + first
                line = " ".join(filter(None, tokens))
                out[-1] += (" " if out[-1] and line else "") + line
                glue = bool(decided & GOES_ON)
                open_ = decided & STATE != STATES.index("break") or glue
            return out

        def work(c: dict) -> dict:
            made = []
            for lines, rest, *labels in zip(*(c[k] for k in ("lines", "rest_words", "nos", "bits", "decided"))):
                made.append(join(top.also(rest).righted, [(lines[no - 1] or "", b, d) for no, b, d in zip(*(x or [] for x in labels)) if not d & (HEAD | COUNTED)]))
            return {"kind": c["kind"], "item_id": c["item_id"], "paragraphs": made, "text": ["\n\n".join(m) for m in made]}

        return work

    return arrow_map(both, start, "kind string, item_id long, paragraphs array<string>, text string")


def repaired_elements(alone: DataFrame, noise: DataFrame, vocabulary: Lexicon | list[str]) -> DataFrame:
    """(item_id, line_no, paragraphs) of draft elements that no unit accounts for, each put right as one paragraph."""
    made = _read_elements(alone, noise, vocabulary, "text", "string", Element.put_right)
    return made.select("item_id", "line_no", F.filter(F.array("text"), lambda t: t != "").alias("paragraphs"))


def draft_paragraphs(units: DataFrame, readings: DataFrame, drafts: DataFrame, made: DataFrame, labels: DataFrame, vocabulary: Lexicon | list[str]) -> DataFrame:
    """(kind, item_id, paragraphs, text) of the drafts of scanned documents; ``made`` has the paragraphs of scanned units, ``labels`` their lines'.

    An element is the paragraphs of the unit it was made of, or is put right for itself.  A draft without text has none.
    """
    parts, matched, alone = elements(units, readings, drafts)
    own = made.where(F.col("kind") == "unit").select(F.col("item_id").alias("unit_id"), "paragraphs")
    # units of one text on one page: the first stands for all; copies of a draft count once
    of_units = matched.groupBy("item_id", "line_no").agg(F.min("unit_id").alias("unit_id")).join(own, "unit_id").select("item_id", "line_no", "paragraphs")
    of_none = parts.where("text is null").select("item_id", F.coalesce("line_no", F.lit(0)).alias("line_no"), F.array().cast("array<string>").alias("paragraphs"))
    every = of_units.unionByName(repaired_elements(alone.dropDuplicates(["item_id", "line_no"]), document_noise(labels), vocabulary)).unionByName(of_none.dropDuplicates(["item_id", "line_no"]))
    element = F.struct("line_no", "paragraphs")
    whole = every.groupBy("item_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(element)), lambda x: x["paragraphs"])).alias("paragraphs"))
    return whole.select(F.lit("draft").alias("kind"), "item_id", "paragraphs", F.array_join("paragraphs", "\n\n").alias("text"))
