"""Answering questions from sources, as dataflow: retrieve, refuse early, ask, verify, try again, decline.

Models and searches are plug-ins over DataFrames, so a whole table of questions is
answered at once: each attempt is one pass over the questions that are still
open, and there are as many passes as depths (two by default).

* search(queries: q_id, query) -> q_id, item_id, rank
* score(pairs: q_id, item_id, question, text) -> q_id, item_id, score
* ask(requests: qid, question, sources; attempt) -> qid, text
* verify(answers: qid, question, text, sources) -> qid, grounded
* rewrite(question) -> queries

Questions: qid, question, language.  A question without sources is refused; a
null or blank reply declines.  Questions are taken to be distinct by qid.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import for_comparison
from . import answers, retrieval

DEPTHS = (5, 10)
#: Sources that each way of answering gets: none, all, or so many of the best.
ARMS: dict[str, int | None] = {"A": 0, "B": None, "C": 5}
# How much the best score of a question to be answered lies above the threshold, and the steps it is rounded to.
MARGIN, STEP = 1.0, 0.5

Search = Callable[[DataFrame], DataFrame]
Ask = Callable[[DataFrame, int], DataFrame]
Verify = Callable[[DataFrame], DataFrame]


class QuotaExhausted(Exception):
    """A service has no more to give today: waiting doesn't help."""


def retrying(call: Callable, tries: int = 5, wait: Callable[[float], None] = time.sleep, passing: tuple[type[Exception], ...] = (OSError,)) -> Callable:
    """``call`` again after failures that pass, with waits of 2, 4, 8 and so on up to 60 seconds; the last failure is raised."""

    def again(*args):
        for n in range(tries):
            try:
                return call(*args)
            except QuotaExhausted:
                raise
            except passing:
                if n == tries - 1:
                    raise
                wait(min(60.0, 2.0 ** (n + 1)))

    return again


def replayed(store: DataFrame) -> Ask:
    """Asking a store of replies (qid, attempt, text); a question that it hasn't got has a null reply."""

    def ask(requests: DataFrame, attempt: int) -> DataFrame:
        return requests.select("qid").join(store.where(F.col("attempt") == attempt).select("qid", "text"), "qid", "left")

    return ask


def asked_one_by_one(model: Callable[[str, list[str]], str]) -> Ask:
    """Asking a model of one request at a time, in the tasks."""

    def ask(requests: DataFrame, attempt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [model(q, s or []) for q, s in zip(b.column("question").to_pylist(), b.column("sources").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(texts, pa.string())], names=["qid", "text"])

        return requests.select("qid", "question", "sources").mapInArrow(run, f"qid {dict(requests.dtypes)['qid']}, text string")

    return ask


def rewritten(questions: DataFrame, rewrite: Callable[[str], Sequence[str]] | None = None, most: int = 3) -> DataFrame:
    """(qid, query_no, query): the question itself first, then at most ``most`` queries that it is rewritten to; off without ``rewrite``."""
    if rewrite is None:
        return questions.select("qid", F.lit(0).alias("query_no"), F.col("question").alias("query"))

    @F.pandas_udf("array<string>")
    def queries(question: pd.Series) -> pd.Series:
        return question.map(lambda q: [q, *list(rewrite(q))[:most]])

    return questions.select("qid", F.posexplode(queries("question")).alias("query_no", "query"))


def searched(queries: DataFrame, search: Search, depth: int) -> DataFrame:
    """(qid, item_id, rank): each question's ranking; those of several queries are fused."""
    numbered = queries.withColumn("q_id", F.xxhash64("qid", "query_no"))
    found = search(numbered.select("q_id", "query")).where(F.col("rank") <= depth).join(numbered.select("q_id", "qid", "query_no"), "q_id")
    scores = found.groupBy("qid", "item_id").agg(F.round(F.sum(1.0 / (F.lit(retrieval.RRF_K) + F.col("rank"))), 9).alias("score"), F.min(F.struct("query_no", "rank")).alias("first"))
    order = retrieval.Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).select("qid", "item_id", "rank")


def overlap(question: Column, text: Column) -> Column:
    """A stand-in for a scorer: the share of a question's words, as compared, that a text holds."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(for_comparison(c), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    own = words(question)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, words(text))) / F.size(own)).otherwise(0.0)


def encoded(texts: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None, dimensions: int = 64, prompt: str = "") -> DataFrame:
    """(item_id, vector) of texts (item_id, text), in Arrow batches; without an encoder, words are hashed to signed places."""

    def hashed(batch: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(batch), dimensions), np.float32)
        for row, text in zip(out, batch):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dimensions] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    made = encode or hashed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vectors = np.asarray(made([prompt + (t or "") for t in b.column("text").to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(list(vectors), pa.list_(pa.float32()))], names=["item_id", "vector"])

    return texts.select("item_id", "text").mapInArrow(run, f"item_id {dict(texts.dtypes)['item_id']}, vector array<float>")


def fusions(dense: Sequence[str], lexical: str = "BM25") -> list[tuple[str, ...]]:
    """Which rankings are fused when retrievers are compared: the lexical one with each dense one, and with all if there are several."""
    return [(lexical, d) for d in dense] + ([(lexical, *dense)] if len(dense) > 1 else [])


def sources_of(rankings: DataFrame, depth: int | None, added: DataFrame | None = None) -> DataFrame:
    """(qid, sources): the ``depth`` best items of each question in order, and what is added to it (qid, source) after them."""
    best = rankings if depth is None else rankings.where(F.col("rank") <= depth)
    own = best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("id")))), lambda x: x["id"]).alias("own"))
    if added is None:
        return own.withColumnRenamed("own", "sources")
    more = added.groupBy("qid").agg(F.array_sort(F.collect_list("source")).alias("more"))
    none = F.array().cast("array<string>")
    return own.join(more, "qid", "full").select("qid", F.concat(F.coalesce("own", none), F.coalesce("more", none)).alias("sources"))


def arm(questions: DataFrame, rankings: DataFrame, ask: Ask, name: str) -> DataFrame:
    """(qid, sources, text): the questions answered the way an arm does, once and unchecked."""
    depth = ARMS[name]
    none = F.array().cast("array<string>")
    own = questions.withColumn("sources", none) if depth == 0 else questions.join(sources_of(rankings, depth), "qid", "left").withColumn("sources", F.coalesce("sources", none))
    return own.select("qid", "sources").join(ask(own.select("qid", "question", "sources"), 1), "qid")


def answered(
    questions: DataFrame,
    rankings: DataFrame,
    ask: Ask,
    declined: Callable[[Column], Column],
    decline: dict[str, str],
    confidence: DataFrame | None = None,
    threshold: float | None = None,
    added: DataFrame | None = None,
    verify: Verify | None = None,
    depths: Sequence[int] = DEPTHS,
) -> DataFrame:
    """(qid, attempts, outcome, reason, cited, answer): outcome is answered, declined or refused.

    rankings (qid, item_id, rank) are worked out once, at the greatest depth, and cut.  A question is refused unasked if it has
    no source, or its confidence (qid, score) is under the threshold and nothing was added for it.  A reply must not decline,
    must cite, cite only its sources, and be grounded, in this order; else the next depth is tried.  After the last a
    decline stands and anything else is refused in the question's language (``decline``: language to sentence).
    """
    if threshold is not None and confidence is None:
        raise ValueError("a threshold needs a confidence")
    said = reduce(lambda acc, kv: F.when(F.col("language") == kv[0], F.lit(kv[1])) if acc is None else acc.when(F.col("language") == kv[0], F.lit(kv[1])), decline.items(), None)
    none = F.array().cast("array<int>")
    names = ["qid", "attempts", "outcome", "reason", "cited", "answer"]
    open_, done = questions, None
    for n, depth in enumerate(depths, 1):
        state = open_.join(sources_of(rankings, depth, added), "qid", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
        state = state.join(confidence.select("qid", "score"), "qid", "left") if confidence is not None else state.withColumn("score", F.lit(None).cast("double"))
        state = state.join(added.select("qid").distinct().withColumn("has_added", F.lit(True)), "qid", "left") if added is not None else state.withColumn("has_added", F.lit(None).cast("boolean"))
        weak = F.col("has_added").isNull() & F.coalesce(F.col("score") < threshold, F.lit(False)) if threshold is not None else F.lit(False)
        state = state.withColumn("early", F.when(F.size("sources") == 0, "no sources").when(weak, "low confidence"))
        refused = state.where("early is not null").select("qid", F.lit(n - 1).alias("attempts"), F.lit("refused").alias("outcome"), F.col("early").alias("reason"), none.alias("cited"), said.alias("answer"))
        asked = state.where("early is null")
        got = asked.join(ask(asked.select("qid", "question", "sources"), n), "qid").withColumn("c", answers.cited(F.coalesce("text", F.lit("")), F.col("sources")))
        got = got.join(verify(got.select("qid", "question", "text", "sources")), "qid", "left") if verify is not None else got.withColumn("grounded", F.lit(True))
        blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
        reason = (
            F.when(blank | F.coalesce(declined(F.col("text")), F.lit(False)), "declined").when((F.size("c.known") == 0) & (F.size("c.unknown") == 0), "no citation")
            .when(F.size("c.unknown") > 0, "unknown citation").when(~F.coalesce("grounded", F.lit(False)), "not grounded").otherwise("")
        )
        got = got.withColumn("reason", reason)
        last = n == len(depths)
        stands = F.col("reason") == ""
        ends = F.lit(True) if last else stands
        outcome = F.when(stands, "answered").when(F.col("reason") == "declined", "declined").otherwise("refused")
        ended = got.where(ends).select(
            "qid", F.lit(n).alias("attempts"), outcome.alias("outcome"), "reason", F.when(outcome == "refused", none).otherwise(F.col("c.known")).alias("cited"), F.when(outcome == "refused", said).otherwise(F.col("text")).alias("answer"),
        )
        part = refused.select(*names).unionByName(ended.select(*names))
        done = part if done is None else done.unionByName(part)
        open_ = got.where(~stands).select(*questions.columns)
    return done


# ------------------------------------------------------------------ confidence


def confidence_of(rankings: DataFrame, scores: DataFrame, depth: int = DEPTHS[0]) -> DataFrame:
    """(qid, score): the best score (qid, item_id, score) among a question's first sources."""
    return rankings.where(F.col("rank") <= depth).join(scores, ["qid", "item_id"]).groupBy("qid").agg(F.max("score").alias("score"))


def refusal_threshold(scored: DataFrame, margin: float = MARGIN, step: float = STEP) -> DataFrame:
    """(lowest, threshold): the least score of a question that should be answered, and the threshold a margin under it, rounded down.

    scored: score, behaviour.
    """
    low = scored.where("behaviour <> 'refuse'").agg(F.min("score").alias("lowest"))
    return low.select("lowest", (F.floor((F.col("lowest") - margin) / step) * step).alias("threshold"))


def score_spread(scored: DataFrame) -> DataFrame:
    """(behaviour, questions, lowest, median, highest) of scores."""
    return scored.groupBy("behaviour").agg(F.count("*").alias("questions"), F.min("score").alias("lowest"), F.median("score").alias("median"), F.max("score").alias("highest"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, wrongly, rightly, to_answer, to_refuse): how many questions of each kind each threshold refuses."""
    refuse = F.col("behaviour") == "refuse"
    each = scored.select("score", "behaviour", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    under = F.col("score") < F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(under & ~refuse).alias("wrongly"), F.count_if(under & refuse).alias("rightly"), F.count_if(~refuse).alias("to_answer"), F.count_if(refuse).alias("to_refuse"))


def lowest(scored: DataFrame, n: int = 5) -> DataFrame:
    """The n questions of the least score."""
    return scored.orderBy("score", "qid").limit(n)
