"""Sets of questions: their problems, splits and samples."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import evidence_words


def problems(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, problem): every rule that a row breaks; null conditions don't break one."""
    found = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))
    return rows.select(key, F.explode(found).alias("problem"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that stand more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def split_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1").select(group, "splits")


def composition(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by every combination of the columns."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def seeded(rows: DataFrame, key: str, n: int, seed: int = 1448) -> DataFrame:
    """n rows drawn by a hash of the seed and the key: the same on any cluster (a top-n, no full sort)."""
    return rows.withColumn("_draw", F.xxhash64(F.lit(seed), key)).orderBy("_draw", key).limit(n).drop("_draw")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 1448, first: Column | None = None) -> DataFrame:
    """About n rows, an equal share of each stratum; what doesn't divide goes to the first strata in order.

    With ``first``, up to half of a stratum's share is drawn from the rows for which it holds, before the rest is drawn from
    all that are left.  No stratum needs more than n rows, so a task sends on no more than n of each.
    """
    strata = rows.select(stratum).distinct().withColumn("_i", F.row_number().over(Window.orderBy(stratum)))  # a row a stratum
    count = strata.agg(F.count("*").alias("_k"))
    quotas = strata.join(F.broadcast(count), how="full").withColumn("_quota", F.floor(F.lit(n) / F.col("_k")) + F.when(F.col("_i") <= n % F.col("_k"), 1).otherwise(0)).select(stratum, "_quota")
    draw = F.xxhash64(F.lit(seed), key)
    own = rows.withColumn("_first", F.coalesce(first, F.lit(False)) if first is not None else F.lit(False)).withColumn("_draw", draw)

    def drawn(df: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(stratum).orderBy("_draw", key))
        return df.withColumn("_r", place).where(F.col("_r") <= n)

    if first is None:
        return drawn(own).join(quotas, stratum).where(F.col("_r") <= F.col("_quota")).select(*rows.columns)
    chosen = drawn(own.where("_first")).join(quotas, stratum).where(F.col("_r") * 2 <= F.col("_quota")).drop("_r", "_quota").persist(StorageLevel.DISK_ONLY)
    left = quotas.join(chosen.groupBy(stratum).agg(F.count("*").alias("_had")), stratum, "left").withColumn("_quota", F.col("_quota") - F.coalesce("_had", F.lit(0)))
    rest = drawn(own.join(chosen.select(key), key, "left_anti")).join(left.select(stratum, "_quota"), stratum).where(F.col("_r") <= F.col("_quota"))
    return chosen.select(*rows.columns).unionByName(rest.select(*rows.columns))


def _orders(names: list[str], n: int, seed: int) -> Iterator[list[str]]:
    """Seeded orders, each a shuffle of the one before it."""
    rng, order = random.Random(seed), sorted(names)
    for _ in range(n):
        rng.shuffle(order)
        yield order


def choose_split(groups: list[tuple[str, dict[str, int]]], shares: dict[str, float], size: int, orders: int, seed: int = 1448) -> list[str]:
    """The groups (name, questions by type) that fill a split of exactly ``size`` nearest to the types' shares.

    In each of the seeded orders the groups go in that still fit; of the orders that fill the split the nearest wins, the
    first on ties.  If none fills it, an error says so.
    """
    parts = dict(groups)
    kinds = sorted({*shares, *(t for p in parts.values() for t in p)})
    table = {g: np.array([p.get(t, 0) for t in kinds]) for g, p in parts.items()}
    target = np.array([shares.get(t, 0.0) * size for t in kinds])
    weigh = np.array([t in shares for t in kinds])

    def taken(order: list[str]) -> tuple[list[str], np.ndarray]:
        have, names = np.zeros(len(kinds), int), []
        for g in order:
            if have.sum() + table[g].sum() <= size:
                have, names = have + table[g], [*names, g]
        return names, have

    full = ((float(np.abs(have - target)[weigh].sum()), names) for names, have in map(taken, _orders(list(parts), orders, seed)) if have.sum() == size)
    best = min(full, key=lambda x: x[0], default=None)
    if best is None:
        raise ValueError(f"no order of the groups fills a split of {size}")
    return best[1]


# ------------------------------------------------------------------ questions

# What a question may be, and how one of each status is to be met.
ANSWERABLE = ("supported", "document_conflict", "scope_comparison")
BEHAVIOUR = {"supported": "answer", "document_conflict": "report_conflict", "scope_comparison": "compare", "partially_supported": "answer_and_name_gap", "unsupported": "refuse", "out_of_scope": "refuse"}
LANGUAGES, SPLITS = ("ar", "en"), ("dev", "final")


def behaviour(status: Column, table: dict[str, str] = BEHAVIOUR) -> Column:
    """How a question of a status is to be met; null for an unknown status."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), status)


def answerable(questions: DataFrame, split: str | None = None) -> DataFrame:
    """Questions that the sources answer, of one split if it is named."""
    own = questions.where(F.col("answerability_status").isin(*ANSWERABLE))
    return own.where(F.col("split") == split) if split else own


def question_rules(types: tuple[str, ...], group_least: int = 2) -> list[tuple[str, Column]]:
    """What is wrong with a question (qid, lang, type, answerability_status, answerable, split, topic_group, source_refs).

    source_refs: array of struct(doc_id, pdf_page, role, quotes).
    """
    refs = F.coalesce(F.size("source_refs"), F.lit(0))
    documents = F.size(F.array_distinct(F.transform("source_refs", lambda r: r["doc_id"])))
    evidence = F.coalesce(F.exists("source_refs", lambda r: F.size(r["quotes"]) > 0), F.lit(False))
    known, status = F.col("answerability_status").isin(*BEHAVIOUR), F.col("answerability_status")
    return [
        ("id", ~F.coalesce(F.col("qid").rlike(r"^g\d{3}$"), F.lit(False))), ("language", ~F.coalesce(F.col("lang").isin(*LANGUAGES), F.lit(False))),
        ("type", ~F.coalesce(F.col("type").isin(*types), F.lit(False))), ("status", ~F.coalesce(known, F.lit(False))),
        ("split", F.col("split").isNotNull() & ~F.col("split").isin(*SPLITS)), ("no topic group", F.col("topic_group").isNull()),
        ("answerable against status", F.col("answerable") != status.isin(*ANSWERABLE)), ("no source", status.isin(*ANSWERABLE) & (refs == 0)),
        ("source without page", F.exists("source_refs", lambda r: r["pdf_page"].isNull() | (r["pdf_page"] < 1))), ("no evidence", status.isin(*ANSWERABLE) & (refs > 0) & ~evidence),
        ("one document", status.isin("document_conflict", "scope_comparison") & (documents < group_least)),
    ]


def unknown_fields(raw: DataFrame, key: str, line: str, allowed: list[str], needed: list[str]) -> DataFrame:
    """(key, problem): fields of raw JSON lines that are not allowed, and needed ones that are missing."""
    names = F.json_object_keys(F.col(line))
    strange = F.transform(F.array_except(names, F.array(*map(F.lit, allowed))), lambda n: F.concat(F.lit("unknown field "), n))
    missing = F.transform(F.array_except(F.array(*map(F.lit, needed)), names), lambda n: F.concat(F.lit("no field "), n))
    return raw.select(key, F.explode(F.array_sort(F.concat(strange, missing))).alias("problem"))


def quotes_missing(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(qid, doc_id, page, quote_no): quotes that their page's text doesn't hold; a page that isn't there once, with no quote_no.

    questions: qid, source_refs; pages: doc_id, page, text.  Texts are compared in their evidence words.
    """
    ref = questions.select("qid", F.explode("source_refs").alias("r")).select("qid", F.col("r.doc_id").alias("doc_id"), F.col("r.pdf_page").alias("page"), F.col("r.quotes").alias("quotes"))
    held = ref.join(pages.select("doc_id", "page", evidence_words(F.col("text")).alias("_words")), ["doc_id", "page"], "left")
    lost = held.where("_words is null").select("qid", "doc_id", "page", F.lit(None).cast("int").alias("quote_no"))
    each = held.where("_words is not null").select("qid", "doc_id", "page", "_words", F.posexplode("quotes").alias("i", "parts"))
    absent = each.where(~F.forall("parts", lambda p: F.col("_words").contains(evidence_words(p))))
    return lost.unionByName(absent.select("qid", "doc_id", "page", (F.col("i") + 1).alias("quote_no"))).distinct()


def frozen(questions: DataFrame, problems_found: DataFrame, held_out: list[str], key: str = "qid") -> DataFrame:
    """The set as it is frozen: each question with its split; an error if any has a problem or wasn't reviewed."""
    bad = questions.join(problems_found.select(key).distinct().withColumn("_bad", F.lit(True)), key, "left")
    wrong = F.coalesce(F.col("_bad"), F.lit(False)) | ~F.coalesce(F.col("reviewed"), F.lit(False))
    safe = F.when(wrong, F.raise_error(F.concat(F.lit("not to be frozen: "), F.col(key))).cast("boolean")).otherwise(F.lit(True))
    return bad.where(safe).withColumn("split", F.when(F.col(key).isin(held_out), "final").otherwise("dev")).withColumn("status", F.lit("frozen")).drop("_bad")


def labelled_items(labels: DataFrame, key: DataFrame, runs: DataFrame) -> DataFrame:
    """(item, run, qid, hand, judge): hand labels (item, label) put to the answers they were given for, by the sheet's key.

    key: item, run, qid; runs: run, qid, judge.  An item or an answer that isn't there raises an error.
    """
    both = labels.join(key.withColumn("_k", F.lit(True)), "item", "left").join(runs.withColumn("_r", F.lit(True)), ["run", "qid"], "left")
    there = F.when(F.col("_k").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("no such item: "), F.col("item").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(there).select("item", "run", "qid", F.col("label").alias("hand"), "judge")
