"""Measures of rankings, readings, runs and raters."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import for_comparison

CUTS = (1, 5, 10, 20)
SEED, DRAWS = 1448, 10_000


# ------------------------------------------------------------------ retrieval


def evidence(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, quote_no, chunk_id or null): the chunks of the quote's page whose words hold all of its parts.

    quotes: qid, quote_no, doc_id, page, parts (array of evidence words); chunks: chunk_id, doc_id, page, words.
    """
    c = chunks.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "chunk_id", "words")
    holds = F.forall("parts", lambda part: F.col("words").contains(part))
    return quotes.join(c, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & holds, "left").select("qid", "quote_no", "chunk_id")


def rank_evidence(holders: DataFrame, ranking: DataFrame) -> DataFrame:
    """(qid, quote_no, rank, held): the best rank of any chunk that holds the quote; null if none is ranked."""
    best = holders.join(ranking.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"], "left")
    return best.groupBy("qid", "quote_no").agg(F.min("rank").alias("rank"), (F.count("chunk_id") > 0).alias("held"))


def per_question(ranks: DataFrame) -> DataFrame:
    """Recall and completeness at each cut, and the reciprocal rank at 10, of each question (qid, quote_no, rank, held, ...)."""
    aggs: list[Column] = []
    for k in CUTS:
        hit = F.coalesce(F.col("rank") <= k, F.lit(False))
        aggs += [F.avg(hit.cast("int")).alias(f"recall_{k}"), F.bool_and(hit).cast("int").alias(f"complete_{k}")]
    best = F.min("rank")
    aggs += [F.when(best <= 10, 1.0 / best).otherwise(0.0).alias("rr_10"), F.count("*").alias("quotes"), F.count_if(~F.col("held")).alias("unheld")]
    return ranks.groupBy("qid").agg(*aggs)


def summary(questions: DataFrame, *by: str) -> DataFrame:
    """Macro means over questions: overall and by each of the columns ``by`` (grouping sets), with the share of quotes held."""
    names = [f"{m}_{k}" for k in CUTS for m in ("recall", "complete")]
    aggs = [F.count("*").alias("questions"), F.round(1 - F.sum("unheld") / F.sum("quotes"), 6).alias("held"), *(F.round(F.avg(n), 6).alias(n) for n in names), F.round(F.avg("rr_10"), 6).alias("mrr_10")]
    sets = [[], *[[F.col(b)] for b in by]]
    return questions.groupingSets(sets, *map(F.col, by)).agg(*aggs)


def compared(results: DataFrame, baseline: DataFrame, value: str = "recall_5") -> DataFrame:
    """(qid, ours, theirs, difference, verdict) of questions both runs answered."""
    a, b = results.select("qid", F.col(value).alias("ours")), baseline.select("qid", F.col(value).alias("theirs"))
    d = F.col("ours") - F.col("theirs")
    return a.join(b, "qid").select("qid", "ours", "theirs", d.alias("difference"), F.when(d > 0, "better").when(d < 0, "worse").otherwise("same").alias("verdict"))


# ------------------------------------------------------------------ numbers


def nearest_rank(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank, p·n rounded half to even, at least the first and at most the last value.

    Equal values are counted first; these counts are laid out by range, so a group of any size lies over many tasks, and a
    value's ranks follow from sums over the ranges before it (a row a range and group).  Null values have no rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    laid = counts.repartitionByRange(*by, "v").withColumn("range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    key = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    ranges = laid.groupBy("range", *by).agg(F.sum("c").alias("held"))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(F.col("range").alias("_range"), *(F.col(b).alias(f"_{b}") for b in by), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(*by)).alias("n"))
    within = Window.partitionBy("range", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = laid.withColumn("upto", F.sum("c").over(within))
    on = F.col("range") == F.col("_range")
    for k in key:
        on = on & k
    at = at.join(before, on).withColumn("last", F.col("before") + F.col("upto"))
    hit = lambda p: F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("n") * p).cast("long"))).between(F.col("last") - F.col("c") + 1, F.col("last"))
    return at.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(hit(p), F.col("v"))).alias(k) for k, p in shares.items()))


def bootstrap(df: DataFrame, value: str, by: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, n, mean, low, high): mean and 95 % interval of the mean over seeded resamples.

    A group's values are drawn in Python's own order of random choices, so intervals are the same on every machine; meant for
    groups of questions (thousands of values): a group is read by one task.
    """

    def run(key, pdf):

        values = pdf[value].dropna().to_numpy(float)
        n = len(values)
        if not n:
            return pd.DataFrame([(key[0], 0, None, None, None)], columns=[by, "n", "mean", "low", "high"])
        rng = random.Random(seed)
        means = np.sort([np.mean(values[rng.choices(range(n), k=n)]) for _ in range(draws)])
        return pd.DataFrame([(key[0], n, values.mean(), means[int(0.025 * draws)], means[int(0.975 * draws) - 1])], columns=[by, "n", "mean", "low", "high"])

    kind = dict(df.dtypes)[by]
    return df.select(by, value).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, mean double, low double, high double")


#: Weights that a task makes at once, and groups whose sums it holds before it sends them on.
WEIGHTS, GROUPS_HELD = 1 << 18, 64


def poisson_weights(keys: np.ndarray, draws: int) -> np.ndarray:
    """Poisson weights of mean 1, a row per key (64-bit hashes) and a column per draw: the same key has the same weights anywhere."""
    # splitmix64: the state of draw i is key + (i + 1) * step
    z = keys.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    weights, total = np.zeros(u.shape, np.uint8), 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        weights += u >= min(round(total * 2**32), 2**32 - 1)
    return weights


def hashed_bootstrap(df: DataFrame, value: str, by: str, key: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, n, mean, low, high), as ``bootstrap``, for groups of any size: each value gets a Poisson weight per draw from a hash of (seed, key).

    A value's weights are one array; a task adds them up by group, so a row per task, group and draw is shuffled, not one
    per value and draw.  Sums are mergeable, so no group is collected and values are read once.  A draw that
    takes no value of a group (which only groups of a few values have) has no mean.
    """
    names = [by, "draw", "s", "w"]
    kind = dict(df.dtypes)[by]

    def run(batches):
        import pyarrow as pa

        held: dict = {}

        def sums():
            for group, (s, w) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(s), kinds[0]), pa.array(np.arange(-1, draws, dtype=np.int32)), pa.array(s), pa.array(w)], names=names)
            held.clear()

        kinds: list = []
        for b in batches:
            kinds[:] = [b.column("by").type]
            keys = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            values = b.column("v").to_numpy(zero_copy_only=False).astype(float)
            rows: dict = {}
            for i, group in enumerate(b.column("by").to_pylist()):
                rows.setdefault(group, []).append(i)
            for group, at in rows.items():
                if group not in held:
                    if len(held) >= GROUPS_HELD:
                        yield from sums()
                    held[group] = np.zeros(draws + 1), np.zeros(draws + 1)
                s, w = held[group]
                at = [i for i in at if not np.isnan(values[i])]
                step = max(1, WEIGHTS // draws)
                for i in range(0, len(at), step):
                    v, weights = values[at[i : i + step]], poisson_weights(keys[at[i : i + step]], draws)
                    # the place before the first draw has the values themselves
                    s[0] += v.sum()
                    w[0] += len(v)
                    s[1:] += v @ weights
                    w[1:] += weights.sum(0)
        yield from sums()

    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = df.select(F.col(by).alias("by"), F.xxhash64(F.lit(seed), F.col(key)).alias("key"), F.col(value).cast("double").alias("v")).repartition(parts, "key")
    each = own.mapInArrow(run, f"`{by}` {kind}, draw int, s double, w double").groupBy(by, "draw").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    m = F.when(F.col("w") > 0, F.col("s") / F.col("w"))
    whole = F.col("draw") < 0
    made = each.groupBy(by).agg(F.max(F.when(whole, F.col("w"))).cast("long").alias("n"), F.max(F.when(whole, m)).alias("mean"), F.array_sort(F.collect_list(F.when(~whole, m))).alias("means"))
    # integers: 0.975 * 10,000 and the like mustn't fall below the whole number
    at = lambda i: F.try_element_at("means", F.greatest(i, F.lit(1)).cast("int"))
    n = F.size("means")
    return made.select(by, "n", "mean", at(F.floor(n * 25 / 1000) + 1).alias("low"), at(F.floor(n * 975 / 1000)).alias("high"))


def paired_interval(ours: DataFrame, theirs: DataFrame, key: str, value: str, draws: int = DRAWS) -> DataFrame:
    """(n, mean, low, high): the mean difference of two runs' values, question by question, with its bootstrap interval.

    No row unless every question of ours is one of theirs.
    """
    both = ours.select(key, F.col(value).cast("double").alias("a")).join(theirs.select(key, F.col(value).cast("double").alias("b")), key, "left")
    whole = both.agg(F.bool_and(F.col("b").isNotNull()).alias("whole"))
    d = both.where("b is not null").select(key, (F.col("a") - F.col("b")).alias("d"), F.lit("all").alias("g"))
    made = hashed_bootstrap(d, "d", "g", key, draws).select("n", "mean", "low", "high")
    return made.join(F.broadcast(whole.where("whole")), how="left_semi")


# ------------------------------------------------------------------ agreement


def confusion(df: DataFrame, first: str, second: str, labels: list) -> DataFrame:
    """(first, one column per label): counts over the fixed labels, zeros filled; a label outside them raises an error."""
    spark = df.sparkSession
    known = F.col(first).isin(labels) & F.col(second).isin(labels)
    safe = df.where(F.coalesce(F.when(known, F.lit(True)), F.raise_error(F.concat(F.lit("unknown label: "), F.concat_ws("/", first, second))).cast("boolean")))
    counts = safe.groupBy(first).pivot(second, labels).count()
    grid = spark.createDataFrame([(x,) for x in labels], f"{first} {dict(df.dtypes)[first]}")
    return grid.join(counts, first, "left").fillna(0)


def kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """(n, agreed, kappa): Cohen's kappa from whole counts; null where chance alone agrees on everything."""
    cells = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreed"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "a").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("chance"))
    both = total.join(F.broadcast(chance), how="full")  # one row each
    below = F.col("n") * F.col("n") - F.col("chance")
    return both.select("n", "agreed", F.when(below != 0, F.round((F.col("agreed") * F.col("n") - F.col("chance")) / below, 6)).alias("kappa"))


# ------------------------------------------------------------------ readings


def bag_overlap(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, in_a, in_b, shared): sizes of two bags of words and of what they share; rows are (key, word)."""
    counts_a = a.groupBy(*key, "word").agg(F.count("*").alias("x"))
    counts_b = b.groupBy(*key, "word").agg(F.count("*").alias("y"))
    both = counts_a.join(counts_b, [*key, "word"], "full").fillna(0, ["x", "y"])
    return both.groupBy(*key).agg(F.sum("x").alias("in_a"), F.sum("y").alias("in_b"), F.sum(F.least("x", "y")).alias("shared"))


def locate(pattern: str, text: str) -> tuple[int, int, int]:
    """(start, end, edits) of the part of ``text`` nearest to ``pattern``; the first to end among the best.

    A row of the alignment at a time: a changed or kept character comes before one left out of the pattern's match, and both
    before one missing from the text.
    """
    n = len(text)
    letters, place = np.array([ord(c) for c in text], np.int64), np.arange(n + 1)
    edits, start = np.zeros(n + 1, np.int64), place
    for i, p in enumerate(pattern, 1):
        beside = np.append(i, edits[:-1] + (letters != ord(p)))  # the first place has no text to stand beside
        above = np.append(i, edits[1:] + 1)
        # runs of extra text: the least of (value - place) so far
        row = np.minimum.accumulate(np.minimum(beside, above) - place) + place
        along = np.append(False, (row[:-1] + 1 == row[1:]) & (beside[1:] != row[1:]))
        fresh = np.where(beside == row, np.append(0, start[:-1]), start)
        fresh[0] = 0
        start = fresh[np.maximum.accumulate(np.where(along, 0, place))]
        edits = row
    end = int(edits.argmin())
    return int(start[end]), end, int(edits[end])


def _located(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:

    return pd.DataFrame([(None, None, None) if p is None or t is None else locate(p, t) for p, t in zip(pattern, text)], columns=["start", "end", "edits"]).astype("Int32")


def located(pattern: Column | str, text: Column | str) -> Column:
    """``locate`` over columns; null in, null out."""
    return F.pandas_udf(_located, "struct<start:int,end:int,edits:int>")(pattern, text)


def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:

    def distance(x, y) -> int:
        ids: dict[str, int] = {}
        p, q = (np.array([ids.setdefault(w, len(ids)) for w in s]) for s in (x, y))
        place = np.arange(len(q) + 1)
        row = place
        for i, w in enumerate(p, 1):
            new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (q != w)))
            # insertions run along the row: a running minimum of (value - place)
            row = np.minimum.accumulate(new - place) + place
        return int(row[-1])

    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def word_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance of two arrays of words, of any length."""
    return F.pandas_udf(_word_distance, "int")(a, b)


def successive(readings: DataFrame, at: str, *page: str) -> DataFrame:
    """(page..., ls, other): the lines of each reading of a page and of the one after it, by ``at``."""
    own = readings.select(*page, at, F.split("result.text", "\n").alias("ls"))
    return own.withColumn("other", F.lead("ls").over(Window.partitionBy(*page).orderBy(at))).where(F.col("ls").isNotNull() & F.col("other").isNotNull()).select(*page, "ls", "other")


#: Forms in which texts are compared: as they are, or with their spelling unified.
FORMS: dict[str, Callable[[Column], Column]] = {"raw": lambda c: c, "normalized": for_comparison}


def error_rates(pairs: DataFrame, by: list[str], form: str = "raw") -> DataFrame:
    """Character and word error rates, weighted by length: pairs (by..., truth, reading); null where the truth is empty."""
    pairs = pairs.withColumn("truth", FORMS[form](F.col("truth"))).withColumn("reading", FORMS[form](F.col("reading")))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    e = pairs.select(
        *by,
        F.levenshtein("truth", "reading").cast("long").alias("edits"), F.length("truth").cast("long").alias("chars"),
        word_distance(words(F.col("truth")), words(F.col("reading"))).cast("long").alias("word_edits"), F.size(words(F.col("truth"))).cast("long").alias("words"),
    )
    rate = lambda a, b: F.when(F.sum(b) > 0, F.round(F.sum(a) / F.sum(b), 6))
    return e.groupBy(*by).agg(F.count("*").alias("pieces"), rate("edits", "chars").alias("cer"), rate("word_edits", "words").alias("wer"))
