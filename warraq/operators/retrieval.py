"""Lexical, dense and fused retrieval over DataFrames.

Rankings have the columns q_id, item_id, rank (from 1) and score.  Every ordering
ends in the item's position (its id), so ties have one result on any cluster.
Empty and null texts have no terms: they count as documents but are never found.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
CANDIDATES, RERANKED = 100, 20
#: Questions of BM25 that meet the corpus at once, and scores that a task works out at once.
QUESTIONS, SCORES = 4096, 4_000_000
#: Numbers of a matrix of questions of dense search (8 bytes each, on every worker), and questions multiplied at once.
MATRIX, BLOCK = 4_000_000, 512


def postings(docs: DataFrame, terms: Column) -> DataFrame:
    """(item_id, term, tf) of docs (item_id, ...)."""
    # the outer form keeps the planner from repeating the analysis in a filter; documents without terms go afterwards
    each = docs.select("item_id", terms.alias("terms")).select("item_id", F.explode_outer("terms").alias("term"))
    return each.where("term is not null").groupBy("item_id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, terms: Column) -> DataFrame:
    """(item_id, length): a document without terms has length 0."""
    return docs.select("item_id", F.coalesce(F.size(terms), F.lit(0)).cast("long").alias("length"))


def idf(n: Column, holding: Column) -> Column:
    """How telling a term is that ``holding`` of ``n`` documents have."""
    return F.log(1 + (n - holding + 0.5) / (holding + 0.5))


def _kept(q: np.ndarray, score: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (question, score, item) the k best of each question: score descending, then item."""
    order = np.lexsort((item, -score, q))
    q, score, item = q[order], score[order], item[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    on = place < k
    return q[on], score[on], item[on]


def _best(scores: np.ndarray, items: np.ndarray, k: int, place: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each column of a matrix of scores above ``least`` (all that tie with the last one, too), as triples."""
    floor = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
    row, column = np.nonzero((scores >= floor) & (scores > least))
    return column + place, scores[row, column], items[row]


class _Held:
    """A task's best of every question so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], 0

    def add(self, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.parts.append(part)
        self.n += len(part[0])
        if self.n > 2_000_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = _kept(*(np.concatenate(x) for x in zip(*self.parts)), self.k)
        self.parts, self.n = [best], 0
        return best

    def batches(self, ids: list):
        import pyarrow as pa

        q, score, item = self.cut()
        names = pa.array(ids, pa.int64())
        for i in range(0, len(q), 50_000):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q[i : i + 50_000])), pa.array(item[i : i + 50_000]), pa.array(score[i : i + 50_000])], names=["q_id", "item_id", "score"])


RANKED = "q_id long, item_id long, score double"


def _passes(asked: DataFrame, most: int) -> list[DataFrame]:
    """Questions in parts of about ``most`` by a hash of their id: one part is sent to the workers at a time."""
    n = max(1, -(-asked.count() // most))
    return [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == i) for i in range(n)]


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25_best(docs: DataFrame, questions: DataFrame, terms: Column, asked: Column, k: int = 10, places: int = 6) -> DataFrame:
    """(q_id, item_id, score): what each task knows of the k best documents of each question (q_id, ...).

    Texts are analyzed once, in the JVM.  ``QUESTIONS`` questions at a time go to the workers as an index from their terms; a
    task scores its documents against them where they lie and sends on k rows a question.  So no posting is shuffled, however
    common its term, and the shuffle carries k rows a task and question whatever the corpus's size.  A term asked twice
    counts twice.
    """
    spark = docs.sparkSession
    own = docs.select("item_id", terms.alias("terms")).persist(StorageLevel.DISK_ONLY)
    total = own.select(F.coalesce(F.size("terms"), F.lit(0)).alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    if not total.n:
        return spark.createDataFrame([], RANKED)
    made = []
    for part in _passes(questions.select("q_id", asked.alias("terms")), QUESTIONS):
        rows = part.where("size(terms) > 0").collect()  # at most about QUESTIONS rows
        ids = sorted({r.q_id for r in rows})
        names = sorted({t for r in rows for t in r.terms})
        if not names:
            continue
        number, at = {t: i for i, t in enumerate(names)}, {q: i for i, q in enumerate(ids)}
        times: dict[tuple[int, int], int] = {}
        for r in rows:
            for t in r.terms:
                times[number[t], at[r.q_id]] = times.get((number[t], at[r.q_id]), 0) + 1
        pairs = np.array([(t, q, n) for (t, q), n in sorted(times.items())])
        starts = np.searchsorted(pairs[:, 0], np.arange(len(names) + 1))
        sent = spark.sparkContext.broadcast((names, pairs[:, 1], pairs[:, 2].astype(float), starts))
        counts = own.select("terms").mapInArrow(_counting(sent), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term asked
        df = np.zeros(len(names))
        for r in counts:
            df[r.term] = r.df
        weight = np.log(1 + (total.n - df + 0.5) / (df + 0.5))
        made.append(own.mapInArrow(_scoring(sent, weight, float(total.mean), ids, k, places), RANKED))
    return _united(made) if made else spark.createDataFrame([], RANKED)


def _occurrences(column, names) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times, lengths) of a column of term lists: how often each row holds each asked term, and rows' lengths."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.index_in(column.flatten(), value_set=names)
    row = np.repeat(np.arange(len(lengths)), lengths)
    on = found.is_valid().to_numpy(zero_copy_only=False)
    key = row[on] * len(names) + pc.fill_null(found, 0).to_numpy(zero_copy_only=False)[on].astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    return key // len(names), key % len(names), times.astype(float), lengths


def _counting(sent):
    def run(batches):
        import pyarrow as pa

        names = pa.array(sent.value[0], pa.string())
        df = np.zeros(len(names), np.int64)
        for b in batches:
            df += np.bincount(_occurrences(b.column(0), names)[1], minlength=len(names))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])

    return run


def _scoring(sent, weight: np.ndarray, mean: float, ids: list, k: int, places: int):
    def run(batches):
        import pyarrow as pa

        words, asks, times, starts = sent.value
        names, held = pa.array(words, pa.string()), _Held(k)
        step = max(1, SCORES // max(1, len(ids)))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                row, term, tf, lengths = _occurrences(b.column(1), names)
                norm = K1 * (1 - B + B * (lengths[row] / mean if mean > 0 else 1.0))
                part = weight[term] * tf * (K1 + 1) / (tf + norm)
                n = starts[term + 1] - starts[term]
                # every occurrence meets the questions that ask for its term
                each = np.repeat(np.arange(len(row)), n)
                pair = np.repeat(starts[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(each)) if len(each) else each
                cell = row[each] * len(ids) + asks[pair]
                scores = np.bincount(cell, part[each] * times[pair], b.num_rows * len(ids)).reshape(b.num_rows, len(ids))
                held.add(_best(np.round(scores, places), b.column(0).to_numpy(zero_copy_only=False), k, 0, 0.0))
        yield from held.batches(ids)

    return run


def top(scores: DataFrame, k: int, places: int = 6) -> DataFrame:
    """The k best of each question: score (rounded, so that no last bit reorders) descending, then item."""
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "item_id")
    return scores.withColumn("score", F.round("score", places)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "item_id", "rank", "score")


def bm25(docs: DataFrame, questions: DataFrame, terms: Column, asked: Column, k: int = 10) -> DataFrame:
    return top(bm25_best(docs, questions, terms, asked, k), k)


def dense(corpus: DataFrame, questions: DataFrame, k: int = 10, dimensions: int | None = None, places: int = 6) -> DataFrame:
    """Exact nearest by dot product: corpus (item_id, vector), questions (q_id, vector); null vectors are left out.

    Questions go to the workers as matrices of at most ``MATRIX`` numbers, a pass over the corpus each; a task multiplies its
    batches with the matrix, ``BLOCK`` questions at a time, keeps the k best of every question and sends on only these.
    """
    spark = corpus.sparkSession
    cut = (lambda c: F.slice(c, 1, dimensions)) if dimensions else (lambda c: c)
    asked = questions.where("vector is not null").select("q_id", cut(F.col("vector")).alias("vector"))
    sides = corpus.where("vector is not null").select("item_id", cut(F.col("vector")).alias("vector"))
    first = asked.select(F.size("vector").alias("n")).first()
    if first is None:
        return top(spark.createDataFrame([], RANKED), k, places)
    made = []
    for part in _passes(asked, max(1, MATRIX // max(1, first.n))):
        rows = part.collect()  # a matrix of bounded size
        ids = [r.q_id for r in rows]
        sent = spark.sparkContext.broadcast(np.array([r.vector for r in rows], np.float64))
        made.append(sides.mapInArrow(_nearest(sent, ids, k, places), RANKED))
    return top(_united(made), k, places)


def _nearest(sent, ids: list, k: int, places: int):
    def run(batches):
        asks, held = sent.value, _Held(k)
        for b in batches:
            items = b.column(0).to_numpy(zero_copy_only=False)
            matrix = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(items), -1)
            for i in range(0, len(asks), BLOCK):
                held.add(_best(np.round(matrix @ asks[i : i + BLOCK].T, places), items, k, i))
        yield from held.batches(ids)

    return run


def fuse(rankings: list[DataFrame], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; ties go to the item that appears first, ranking by ranking."""
    together = None
    for no, r in enumerate(rankings):
        part = r.select("q_id", "item_id", "rank", F.lit(no).alias("ranking"))
        together = part if together is None else together.unionByName(part)
    scores = together.groupBy("q_id", "item_id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("score"), F.min(F.struct("ranking", "rank")).alias("first"))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "first")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return (ranked.where(F.col("rank") <= k) if k else ranked).select("q_id", "item_id", "rank", "score")


def rerank(ranking: DataFrame, scores: DataFrame, depth: int = RERANKED) -> DataFrame:
    """The first ``depth`` of a ranking in the order of other scores (q_id, item_id, score); the rest stays.

    Ties keep the old order; an item without a score comes after those that have one.
    """
    both = ranking.select("q_id", "item_id", F.col("rank").alias("old")).join(scores.select("q_id", "item_id", "score"), ["q_id", "item_id"], "left")
    head = F.col("old") <= depth
    order = Window.partitionBy("q_id").orderBy(~head, F.when(head, F.col("score")).desc_nulls_last(), "old")
    return both.withColumn("rank", F.row_number().over(order)).select("q_id", "item_id", "rank", "old", "score")


def hybrid(rankings: list[DataFrame], scores: DataFrame, k: int = 5, depth: int = RERANKED) -> DataFrame:
    """Candidates of each retriever, fused, their head reranked, cut to k."""
    fused = fuse([r.where(F.col("rank") <= CANDIDATES) for r in rankings])
    return rerank(fused, scores, depth).where(F.col("rank") <= k)


def pool(rankings: list[DataFrame]) -> DataFrame:
    """(q_id, item_id, first): the distinct items of several rankings, in the order first seen."""
    together = None
    for no, r in enumerate(rankings):
        part = r.select("q_id", "item_id", F.struct(F.lit(no).alias("ranking"), "rank").alias("place"))
        together = part if together is None else together.unionByName(part)
    seen = together.groupBy("q_id", "item_id").agg(F.min("place").alias("place"))
    return seen.select("q_id", "item_id", F.row_number().over(Window.partitionBy("q_id").orderBy("place")).alias("first"))
