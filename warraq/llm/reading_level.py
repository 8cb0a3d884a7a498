"""Reading level of each document (problem 8).

Every word of the graded samples gets an acquisition grade: of its relative
frequencies by level, made to add up to one, the level by which ``ACQUIRED`` of
them is reached (interpolated).  A sentence's level is predicted from quantiles
of its known words' grades by a least-squares fit on the samples' sentences; the
bounds between levels are calibrated on them too.  A document's level is the
level by which half of its own words is reached; the share of words in hard
sentences is given beside it.

The model is fitted on the driver from at most ``SAMPLES`` graded texts and sent
with the tasks: a grade per distinct word of these, and some twenty numbers.
Documents are scored where they lie, whole; the wordings that a site repeats (see
``repeated_lines``) and the title's line are set aside first.  Their table is
broadcast only if it was counted at no more than ``repeated_lines.BROADCAST_ROWS``;
beyond that it is joined by shuffle.

Nulls: a null or wordless text has no level and a hard share of 0; a document
without a source has no site matter; one without a title no title line.
Copies of a document count once.  Without samples no word has a grade and no
document a level.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, arrow_map, once, sent, with_rest
from .look import LookForm, Wording, answered_readings, asked_readings
from .repeated_lines import document_items, hash64, site_sets

SAMPLES = 10_000
ACQUIRED = 0.25
QUANTILES = (0.25, 0.5, 0.75, 0.9)
HARD = 4
#: Texts with fewer sentence marks than one in so many words are taken line by line.
WORDS_PER_MARK = 60

_VOWELS = re.compile("[\u064b-\u0652ـ]")
_WORD = re.compile(r"[^\W_]")
_BULLET = re.compile(r"(?:[*•▪◦\-–]|\(?[\d٠-٩]{1,3}[.)\-]|[.\-][\d٠-٩]{1,3})$")
_END = ".!?؟…;؛"
_TRIM = ".,;:!?()[]{}«»\"'“”،؛؟|*•▪–—-/>…`"


class Plain(dict):
    """token -> (the plain word by which grades are kept, whether it ends a sentence, counts as a word, is a bullet or number)."""

    def __init__(self, looks: LookForm):
        super().__init__()
        self.looks = looks

    def __missing__(self, token: str) -> tuple[str, bool, bool, bool]:
        if len(self) > 500_000:
            self.clear()
        form = self.looks[token]
        closed = form.rstrip("])»\"'”")
        got = (_VOWELS.sub("", form.strip(_TRIM)).casefold(), closed[-1:] in _END if closed else False, bool(_WORD.search(form)), bool(_BULLET.match(form)))
        self[token] = got
        return got


def sentences(lines: list[str], plain: Plain) -> list[list[str]]:
    """The plain words of each sentence of a text's own lines."""
    split = [ln.split() for ln in lines]
    read = [[plain[t] for t in ts] for ts in split]
    by_line = sum(r[1] for rs in read for r in rs) * WORDS_PER_MARK < sum(map(len, read))
    out: list[list[str]] = []
    now: list[str] = []

    def close() -> None:
        nonlocal now
        if now:
            out.append(now)
        now = []

    for rows in read:
        marked = bool(rows) and rows[0][3]
        if by_line or marked or not rows:
            close()
        for word, ends, counts, _ in rows[1:] if marked else rows:
            if counts:
                now.append(word)
            if ends:
                close()
    close()
    return out


class Model:
    """Grades of words and how quantiles of them make a level."""

    def __init__(self, grades: dict[str, float], weights: np.ndarray, bounds: list[float]):
        self.grades, self.weights, self.bounds = grades, list(map(float, weights)), bounds

    def features(self, words: list[str]) -> list[float] | None:
        known = [g for w in words if (g := self.grades.get(w)) is not None]
        if not known:
            return None
        known.sort()
        n = len(known) - 1
        out = [1.0]
        for q in QUANTILES:
            k = int(q * n)
            low = known[k]
            out.append(low + (known[k + 1] - low) * (q * n - k) if k < n else low)
        return out

    def level(self, words: list[str]) -> int | None:
        """The level of a sentence, 1 to 5; None without a known word."""
        f = self.features(words)
        return None if f is None else 1 + bisect_right(self.bounds, sum(a * b for a, b in zip(f, self.weights)))


def fit(samples: list[tuple[int, str]], vocabulary: list[str]) -> Model:
    """The model of graded texts (level, text)."""
    plain = Plain(LookForm(vocabulary))
    parts = [(level, sentences(text.split("\n"), plain)) for level, text in samples if level is not None and text]
    counts: dict[str, np.ndarray] = {}
    totals: dict[bool, np.ndarray] = {False: np.zeros(5), True: np.zeros(5)}
    script = lambda w: "\u0600" <= w[:1] <= "ۿ"
    for level, ss in parts:
        for s in ss:
            for w in s:
                if w and not w[0].isdigit():
                    counts.setdefault(w, np.zeros(5))[level - 1] += 1
                    totals[script(w)][level - 1] += 1
    grades = {}
    for w, c in counts.items():
        share = c / np.maximum(totals[script(w)], 1)
        reached = np.cumsum(share / share.sum())
        k = int(np.searchsorted(reached, ACQUIRED))
        before = reached[k - 1] if k else 0.0
        grades[w] = k + 0.5 + (ACQUIRED - before) / (reached[k] - before)
    model = Model(grades, np.zeros(len(QUANTILES) + 1), [1.5, 2.5, 3.5, 4.5])
    rows = [(f, level) for level, ss in parts for s in ss if (f := model.features(s)) is not None]
    if rows:
        x, y = np.array([f for f, _ in rows]), np.array([lv for _, lv in rows], float)
        model.weights = np.linalg.solve(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ y).tolist()
        made = x @ np.array(model.weights)
        for k in range(4):
            # the bound with the fewest sentences on the wrong side, the levels weighted alike
            low, high = np.sort(made[y <= k + 1]), np.sort(made[y > k + 1])
            if len(low) and len(high):
                at = np.unique(np.concatenate([low, high]))
                mid = (at[1:] + at[:-1]) / 2 if len(at) > 1 else at
                wrong = 1 - np.searchsorted(low, mid) / len(low) + np.searchsorted(high, mid) / len(high)
                best = np.flatnonzero(wrong == wrong.min())
                model.bounds[k] = float(mid[best[len(best) // 2]])
        model.bounds = list(np.maximum.accumulate(model.bounds))
    return model


LEVELS = "doc_id long, level int, hard_words long, words long, hard_share double"


def levels(documents: DataFrame, samples: DataFrame, vocabulary: Lexicon | list[str]) -> DataFrame:
    """(doc_id, level, hard_words, words, hard_share): each document once."""
    graded = samples.where("level between 1 and 5 and text is not null").orderBy("sample_id").limit(SAMPLES).select("level", "text").collect()
    own = sent(vocabulary)
    model = fit([(r.level, r.text) for r in graded], own)
    site, small = site_sets(document_items(documents), vocabulary)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "text", F.when(F.col("source").isNotNull(), F.xxhash64(F.lit("document"), F.col("source").cast("string"))).alias("gid"))
    docs = docs.join(F.broadcast(site) if small else site, "gid", "left")

    def start():
        looks = once(LookForm, own)
        usual = Plain(looks), Wording(looks)
        known: dict[tuple[str, ...], int | None] = {}

        def level_of(words: list[str]) -> int | None:
            key = tuple(words)
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                known[key] = model.level(words)
            return known[key]

        def work(c: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "level", "hard_words", "words", "hard_share")}
            for doc, title, text, site, rest in zip(*(c[k] for k in ("doc_id", "title", "text", "site", "rest_words"))):
                plain, wording = (Plain(looks.also(rest)), Wording(looks.also(rest))) if rest else usual
                aside = set(site or ())
                if title:
                    aside.add(hash64(wording.line(title)))
                own = [ln for ln in (text or "").split("\n") if not (ln and hash64(wording.line(ln)) in aside)]
                by = np.zeros(6, int)
                for s in sentences(own, plain):
                    by[level_of(s) or 0] += len(s)
                words, graded, hard = int(by.sum()), np.cumsum(by[1:]), int(by[HARD:].sum())
                level = int(np.searchsorted(graded, graded[-1] / 2) + 1) if graded[-1] else None
                for k, v in zip(out, (doc, level, hard, words, hard / words if words else 0.0)):
                    out[k].append(v)
            return out

        return work

    docs = with_rest(docs.select("doc_id", "title", "text", "site"), ["doc_id"], vocabulary, lambda: lambda c: (asked_readings(x) for x in zip(c["title"], c["text"])), answered_readings)
    return arrow_map(docs, start, LEVELS).dropDuplicates(["doc_id"])
