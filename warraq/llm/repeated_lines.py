"""Lines that a source repeats over its documents (problem 1).

1. Every line's wording (its look without figures, dates, letter case and white
   space) is hashed to 64 bits; only (source, page, item, line, hash) goes on.
2. Each task keeps a Misra-Gries summary per source.  Summaries are mergeable:
   the sum of the tasks' counters of a wording, plus the source's error bound
   ``lines / (capacity + 1)``, is at least its true number of lines.  With a
   capacity of ``SLACK * lines / needed`` the bound is below a quarter of the
   pages needed, so no wording that reaches the threshold is lost, at any size
   and in any order of arrival, and only some tens of counters a page remain.
3. The lines of the candidate wordings alone are counted exactly (distinct
   pages), and those of confirmed wordings are found and removed.

Shuffles are keyed by (source, wording), so a source with a third of all rows is
spread over all tasks; joins against candidates are left to the adaptive planner,
which broadcasts a side only when its measured size is under Spark's threshold.

Nulls: items without a source belong to none and keep their lines; a null line
is no line (its number still counts); a line on a null page is on no page.
Copies of an item (same id) count once.  Empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, arrow_map, once, sent, with_rest
from .look import LookForm, Wording, answered_readings, asked_readings

#: A wording is repeated if it stands on this share of the source's pages, and on at least so many.
SHARE, LEAST = 0.1, 5
#: Counters per needed page: the summary's error is below needed / SLACK.
SLACK = 4

_LETTER = re.compile(r"[^\W\d_]")
ROWS = "kind string, source string, page long, item_id long, line_no int, wording long"


def hash64(text: str) -> int:
    """A signed 64-bit hash."""
    return (xxhash.xxh3_64_intdigest(text) ^ (1 << 63)) - (1 << 63)


def line_rows(items: DataFrame, words: Lexicon | list[str]) -> DataFrame:
    """One row per line with a letter; ``items`` has kind, source, page, item_id, lines (array of string)."""
    own = sent(words)

    def start():
        look = once(LookForm, own)
        usual = Wording(look)

        def work(c: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("kind", "source", "page", "item_id", "line_no", "wording")}
            add = [out[k].append for k in out]
            for kind, source, page, item, lines, rest in zip(*(c[k] for k in ("kind", "source", "page", "item_id", "lines", "rest_words"))):
                if source is None or lines is None:
                    continue
                wording = Wording(look.also(rest)) if rest else usual
                for no, line in enumerate(lines, 1):
                    if line and _LETTER.search(w := wording.line(line)):
                        for put, value in zip(add, (kind, source, page, item, no, hash64(w))):
                            put(value)
            return out

        return work

    return arrow_map(with_readings(items.select("kind", "source", "page", "item_id", "lines"), words), start, ROWS)


def with_readings(items: DataFrame, words: Lexicon | list[str]) -> DataFrame:
    """Items (kind, item_id, lines) with the rarer words that decide how their lines look."""
    return with_rest(items, ["kind", "item_id"], words, lambda: lambda c: (asked_readings(x or ()) for x in c["lines"]), answered_readings)


def summarize(keys: np.ndarray, words: np.ndarray, counts: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge counters of equal (key, word) and cut every key's counters to its capacity, as Misra and Gries do.

    The (capacity + 1)-th largest counter of a key is taken from all of its counters; those at zero go.
    """
    order = np.lexsort((words, keys))
    keys, words, counts, caps = keys[order], words[order], counts[order], caps[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (words[1:] != words[:-1])
    at = np.flatnonzero(first)
    keys, words, caps, counts = keys[at], words[at], caps[at], np.add.reduceat(counts, at) if len(at) else counts
    order = np.lexsort((-counts, keys))
    keys, words, counts, caps = keys[order], words[order], counts[order], caps[order]
    group = np.ones(len(keys), bool)
    group[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(group)
    number = np.cumsum(group) - 1
    size = np.diff(np.append(starts, len(keys)))
    cut_at = starts + caps[starts] if len(starts) else starts
    cut = np.where(size > caps[starts], counts[np.minimum(cut_at, len(keys) - 1)], 0) if len(starts) else starts
    counts = counts - cut[number] if len(starts) else counts
    keep = counts > 0
    return keys[keep], words[keep], counts[keep], caps[keep]


def heavy_hitters(rows: DataFrame, every: int = 100_000) -> DataFrame:
    """(gid, wording, n): the tasks' summaries of (gid, cap, wording) rows, merged by sum."""

    def run(batches):
        held = [np.empty(0, np.int64)] * 4
        waiting: list[tuple] = []
        n = 0

        def merged():
            return summarize(*(np.concatenate([h, *(w[i] for w in waiting)]) for i, h in enumerate(held)))

        for b in batches:
            gid, cap, wording = (b.column(k).to_numpy(zero_copy_only=False) for k in ("gid", "cap", "wording"))
            waiting.append((gid, wording, np.ones(len(gid), np.int64), cap))
            if (n := n + len(gid)) >= every:
                held, waiting, n = list(merged()), [], 0
        keys, words, counts, _ = merged()
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (keys, words, counts)], names=["gid", "wording", "n"])

    return rows.select("gid", "cap", "wording").mapInArrow(run, "gid long, wording long, n long").groupBy("gid", "wording").agg(F.sum("n").alias("n"))


def repeated(rows: DataFrame, pages: DataFrame, share: float = SHARE, least: int = LEAST, key: tuple[str, ...] = ("kind", "source")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, wordings, proposed) of repeated wordings; ``key`` names the columns that make a source.

    ``rows``: what ``line_rows`` gives, read several times (persist it).  ``pages``: kind, source, page of all pages there are.
    ``wordings`` has gid, wording, n (pages that hold it), n_pages; ``proposed`` are the rows of all wordings that had to be counted.
    """
    gid = F.xxhash64(*key).alias("gid")
    per = pages.where("source is not null").groupBy(gid).agg(F.count_distinct("page").alias("n_pages"))
    rows = rows.withColumn("gid", F.xxhash64(*key))
    lines = rows.groupBy("gid").agg(F.count("*").alias("n_lines"))
    needed = F.greatest(F.lit(float(least)), F.col("n_pages") * share)
    stats = per.join(lines, "gid").withColumn("needed", needed).withColumn("cap", F.ceil(SLACK * F.col("n_lines") / F.col("needed")).cast("long"))
    hits = heavy_hitters(rows.join(stats.select("gid", "cap"), "gid"))
    candidates = hits.join(stats, "gid").where(F.col("n") + F.col("n_lines") / (F.col("cap") + 1) >= F.col("needed")).select("gid", "wording")
    lines = rows.join(candidates, ["gid", "wording"], "left_semi")
    counted = lines.groupBy("gid", "wording").agg(F.count_distinct("page").alias("n"))
    wordings = counted.join(per, "gid").where((F.col("n") >= least) & (F.col("n") >= F.col("n_pages") * F.lit(share)))
    found = lines.join(wordings.select("gid", "wording"), ["gid", "wording"], "left_semi")
    return found.select("kind", "item_id", "line_no").distinct(), wordings, lines


def unit_items(units: DataFrame) -> DataFrame:
    """Units as items: the doc_id is the source."""
    return units.select(F.lit("unit").alias("kind"), F.col("doc_id").cast("string").alias("source"), F.col("page").cast("long").alias("page"), F.col("unit_id").cast("long").alias("item_id"), "lines")


def document_items(documents: DataFrame) -> DataFrame:
    """Documents as items: each is a page of its site."""
    return documents.select(
        F.lit("document").alias("kind"), F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("page"), F.col("doc_id").cast("long").alias("item_id"), F.split("text", "\n").alias("lines")
    )


def find(items: DataFrame, words: Lexicon | list[str]) -> DataFrame:
    """(kind, item_id, line_no) of every repeated line of the items."""
    rows = line_rows(items, words).persist(StorageLevel.DISK_ONLY)
    return repeated(rows, items.select("kind", "source", "page"))[0]


#: Most confirmed wordings that are broadcast; more are joined by shuffle, with the same result.
BROADCAST_ROWS = 100_000


def site_sets(items: DataFrame, words: Lexicon | list[str]) -> tuple[DataFrame, bool]:
    """(gid, site): the hashes of each source's confirmed wordings, and whether the table is small enough to broadcast.

    A wording stands on a tenth of its source's pages, so a set has at most ten times a page's lines.
    """
    rows = line_rows(items, words).persist(StorageLevel.DISK_ONLY)
    wordings = repeated(rows, items.select("kind", "source", "page"))[1].select("gid", "wording").persist(StorageLevel.DISK_ONLY)
    return wordings.groupBy("gid").agg(F.collect_set("wording").alias("site")), wordings.count() <= BROADCAST_ROWS


def without(items: DataFrame, words: Lexicon | list[str]) -> DataFrame:
    """(kind, item_id, lines, removed): each item once, without its source's repeated lines, and how many went.

    The confirmed wordings go to the texts as broadcast sets; texts are shuffled once, to drop copies.
    """
    sets, small = site_sets(items, words)
    own = items.select("kind", "item_id", "lines", F.when(F.col("source").isNotNull(), F.xxhash64("kind", "source")).alias("gid"))
    own = with_readings(own.join(F.broadcast(sets) if small else sets, "gid", "left").select("kind", "item_id", "lines", "site"), words)
    top = sent(words)

    def start():
        look = once(LookForm, top)
        usual = Wording(look)

        def kept(lines: list[str | None], site: set[int], rest: list[str] | None) -> list[str | None]:
            wording = Wording(look.also(rest)) if rest else usual
            return [x for x in lines if not (x and _LETTER.search(w := wording.line(x)) and hash64(w) in site)]

        def work(c: dict) -> dict:
            made = [x if x is None or not site else kept(x, set(site), rest) for x, site, rest in zip(c["lines"], c["site"], c["rest_words"])]
            return {"kind": c["kind"], "item_id": c["item_id"], "lines": made, "removed": [0 if a is None else len(a) - len(b) for a, b in zip(c["lines"], made)]}

        return work

    return arrow_map(own, start, "kind string, item_id long, lines array<string>, removed int").dropDuplicates(["kind", "item_id"])
