"""Oversized items cut at natural boundaries (problem 5).

The least number of pieces follows from the item's words, the limit and the
overlap.  Equal-length targets are placed, each snapped to the strongest boundary
near it; when a piece then breaks the limit the cut is taken back, and when no
cut serves a piece is added.  Every piece but the first starts with exactly
``overlap`` words of the one before it, so each piece's first new word is
``overlap`` words after its start.

Boundaries, strongest first: between the texts of a draft, before a clause
number, at a line feed, after a sentence, after a semicolon or colon, after a
comma, between words.  Equally strong ones: the nearest to the target, then the
earlier.

All work is per row; items that can't be too long by their number of characters
are dropped before they leave the JVM.  Null texts have no words; an item whose
content type has no limit (or is null) is never cut; an overlap of the limit or
more is cut to the limit less one.  Copies of an item count once.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Unicode's white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[^{SPACE}]+")
_INNER = re.compile(r"\w")
_CLAUSE = re.compile(r"(?:[.\-(\[]?[0-9٠-٩]{1,3}[.)\-\]]{0,2}|[.\-][0-9٠-٩]{1,3}|[•▪*])$")
STRENGTHS = {"text": 6, "clause": 5, "line": 4, "sentence": 3, "colon": 2, "comma": 1, "word": 0}
NAMES = {v: k for k, v in STRENGTHS.items()}
#: A cut may lie this share of a piece's new words away from its target.
WINDOW = 0.35


def spans(text: str) -> list[tuple[int, int]]:
    """Where the words of a text are: runs without white space that hold a letter, digit or underscore."""
    return [m.span() for m in _RUN.finditer(text) if _INNER.search(m.group())]


def strengths(text: str, words: list[tuple[int, int]], joints: set[int]) -> np.ndarray:
    """How strong the boundary before each word is; ``joints``: the offsets where the texts of a draft begin."""
    out = np.zeros(len(words) + 1, int)
    starts = sorted(joints)
    j = 0
    for i in range(1, len(words)):
        end, start = words[i - 1][1], words[i][0]
        between = text[end:start]
        while j < len(starts) and starts[j] <= end:
            j += 1
        tail = text[max(0, end - 4) : end].rstrip("])»\"'”")[-1:]
        if j < len(starts) and starts[j] <= start:
            s = 6
        elif _CLAUSE.match(text[start : words[i][1]]) and (tail in ".!?؟" or "\n" in between):
            s = 5
        elif "\n" in between:
            s = 4
        elif tail and tail in ".!?؟…":
            s = 3
        elif tail and tail in ";:؛":
            s = 2
        elif tail and tail in ",،":
            s = 1
        else:
            s = 0
        out[i] = s
    return out


def cuts(n: int, limit: int, overlap: int, strength: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of each piece of an item of n words."""
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    fresh = limit - overlap
    pieces = math.ceil((n - overlap) / fresh)
    while True:
        ends, start, ok = [], 0, True
        for k in range(1, pieces):
            # equal shares of what is left; a cut must leave no more than the pieces to come can hold
            left = pieces - k
            done = ends[-1] if ends else overlap
            target = done + (n - done) / (left + 1)
            low = max(done + 1, n - left * fresh, start + overlap + 1 if k > 1 else overlap + 1)
            high = min(start + limit, n - 1)
            if low > high:
                ok = False
                break
            reach = max(1, int(WINDOW * fresh))
            a, b = max(low, math.floor(target) - reach), min(high, math.ceil(target) + reach)
            if a > b:
                a = b = min(max(round(target), low), high)
            near = np.arange(a, b + 1)
            end = int(near[np.lexsort((near, np.abs(near - target), -strength[near]))[0]])
            ends.append(end)
            start = end - overlap
        if ok and n - start <= limit:
            bounds = [*ends, n]
            return [(0 if i == 0 else bounds[i - 1] - overlap, e) for i, e in enumerate(bounds)]
        pieces += 1


def split(texts: list[str], limit: int, overlap: int) -> list[dict]:
    """The pieces of an item whose texts follow each other, joined by a line feed."""
    text = "\n".join(texts)
    joints, at = set(), 0
    for t in texts[:-1]:
        at += len(t) + 1
        joints.add(at)
    words = spans(text)
    strength = strengths(text, words, joints)
    out = []
    for no, (a, b) in enumerate(cuts(len(words), limit, overlap, strength), 1):
        begin = 0 if a == 0 else words[a][0]
        end = len(text) if b == len(words) else words[b][0]
        out.append({"piece_no": no, "n_words": b - a, "overlap": overlap if no > 1 else 0, "cut_at": "end" if b == len(words) else NAMES[int(strength[b])], "text": text[begin:end].rstrip() if b < len(words) else text[begin:end]})
    return out


def unit_items(units: DataFrame) -> DataFrame:
    return units.select(F.lit("unit").alias("kind"), F.col("unit_id").cast("long").alias("item_id"), "content_type", F.array("text").alias("texts"))


def draft_items(drafts: DataFrame) -> DataFrame:
    return drafts.select(F.lit("draft").alias("kind"), F.col("draft_id").cast("long").alias("item_id"), "content_type", "texts")


PIECES = "kind string, item_id long, piece_no int, n_pieces int, n_words int, overlap int, cut_at string, text string"


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items that may have more words than their limit, with limit and overlap; no copies.

    A word takes at least one character and one of white space, so shorter items can't; ``limits`` has a row per content type.
    """
    most = limits.where("content_type is not null and max_words > 0").groupBy("content_type").agg(F.min("max_words").alias("max_words"), F.max(F.coalesce("overlap_words", F.lit(0))).alias("overlap_words"))
    size = F.aggregate(F.transform("texts", lambda t: F.coalesce(F.length(t), F.lit(0))), F.lit(0), lambda a, b: a + b + 1)
    return items.join(most, "content_type").where(size > 2 * F.col("max_words")).dropDuplicates(["kind", "item_id"])


def pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every item that is too long."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def start():
        def work(c: dict) -> dict:
            out: dict[str, list] = {k: [] for k in names}
            for kind, item, texts, limit, overlap in zip(c["kind"], c["item_id"], c["texts"], c["max_words"], c["overlap_words"]):
                made = split([t or "" for t in texts or []], limit, overlap)
                if len(made) > 1:
                    for p in made:
                        for k, v in ({"kind": kind, "item_id": item, "n_pieces": len(made)} | p).items():
                            out[k].append(v)
            return out

        return work

    return arrow_map(oversized(items, limits).select("kind", "item_id", "texts", "max_words", "overlap_words"), start, PIECES)
