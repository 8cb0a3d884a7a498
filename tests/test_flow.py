"""Plug-ins of the answering flow, question sets and small pieces, by stated results."""

import pytest
from pyspark.sql import functions as F

from warraq.operators import evaluation, flow, gold, layout, stores
from warraq.sources import engines, readers, sinks


def test_retries_wait_longer_and_stop():
    waits, left = [], [OSError(), OSError()]

    def call(x):
        if left:
            raise left.pop()
        return x

    assert flow.retrying(call, wait=waits.append)(7) == 7 and waits == [2.0, 4.0]
    waits.clear()
    left[:] = [OSError()] * 9
    with pytest.raises(OSError):
        flow.retrying(call, tries=3, wait=waits.append)(7)
    assert waits == [2.0, 4.0]

    def spent(x):
        raise flow.QuotaExhausted("no more today")

    with pytest.raises(flow.QuotaExhausted):
        flow.retrying(spent, wait=waits.append)(1)


def test_models_one_request_at_a_time(spark):
    q = spark.createDataFrame([("a", "who?", ["s1", "s2"]), ("b", "what?", None)], "qid string, question string, sources array<string>")
    got = {r.qid: r.text for r in flow.asked_one_by_one(lambda question, sources: f"{question} {len(sources)}")(q, 1).collect()}
    assert got == {"a": "who? 2", "b": "what? 0"}


def test_a_threshold_needs_a_confidence(spark):
    q = spark.createDataFrame([], "qid string, question string, language string")
    with pytest.raises(ValueError):
        flow.answered(q, q, lambda r, n: r, lambda c: F.lit(False), {"en": "no"}, threshold=1.0)


def test_the_flow_of_no_questions(spark):
    q = spark.createDataFrame([], "qid string, question string, language string")
    r = spark.createDataFrame([], "qid string, item_id string, rank int")
    store = spark.createDataFrame([], "qid string, attempt int, text string")
    assert flow.answered(q, r, flow.replayed(store), lambda c: F.lit(False), {"en": "no"}).count() == 0


def test_stand_ins(spark):
    df = spark.createDataFrame([("fees and dates", "The dates and the fees."), ("", "x")], "q string, t string")
    assert [r[0] for r in df.select(flow.overlap(F.col("q"), F.col("t"))).collect()] == [1.0, 0.0]
    v = {r.item_id: r.vector for r in flow.encoded(spark.createDataFrame([(1, "a b"), (2, "b a"), (3, None)], "item_id long, text string"), dimensions=16).collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and not any(v[3])
    assert flow.fusions(["d1", "d2"]) == [("BM25", "d1"), ("BM25", "d2"), ("BM25", "d1", "d2")] and flow.fusions(["d"]) == [("BM25", "d")]


def test_splits_follow_one_shuffle():
    import random

    groups = [(g, {"x": n}) for g, n in (("a", 2), ("b", 3), ("c", 4), ("d", 5))]
    rng, names, seen = random.Random(1448), ["a", "b", "c", "d"], []
    size = dict((g, p["x"]) for g, p in groups)
    for _ in range(6):
        rng.shuffle(names)
        taken = []
        for g in names:
            if sum(size[x] for x in taken) + size[g] <= 7:
                taken.append(g)
        seen.append(taken)
    first = next(t for t in seen if sum(size[x] for x in t) == 7)
    assert gold.choose_split(groups, {"x": 1.0}, 7, 6) == first
    with pytest.raises(ValueError):
        gold.choose_split(groups, {"x": 1.0}, 1, 6)


def test_a_set_with_problems_is_not_frozen(spark):
    q = spark.createDataFrame([("g1", True), ("g2", False)], "qid string, reviewed boolean")
    with pytest.raises(Exception, match="not to be frozen: g2"):
        gold.frozen(q, q.limit(0).select("qid"), ["g1"]).collect()
    with pytest.raises(Exception, match="not to be frozen: g1"):
        gold.frozen(q.where("reviewed"), q.where("reviewed").select("qid"), []).collect()


def test_paired_intervals_need_every_pair(spark):
    a = spark.createDataFrame([(f"q{i}", float(i % 2)) for i in range(40)], "qid string, s double")
    b = a.withColumn("s", F.lit(0.25))
    r = evaluation.paired_interval(a, b, "qid", "s", 500).collect()
    assert len(r) == 1 and r[0].n == 40 and r[0].mean == 0.25 and r[0].low < 0.25 < r[0].high
    assert evaluation.paired_interval(a, b.limit(39), "qid", "s", 500).count() == 0


def test_stores_that_were_made_otherwise(spark):
    s = stores.described(spark.createDataFrame([("k", 1.0)], "key string, score double"), model="m1")
    assert stores.made_by(s, model="m1").count() == 1
    with pytest.raises(Exception, match="made otherwise"):
        stores.made_by(s, model="m2").collect()
    rows = [("k", "old", False, None, 1), ("k", "new", False, None, 2), ("k", "cut", True, None, 3), ("d", None, False, "damaged", 1)]
    assert [r.text for r in stores.usable(spark.createDataFrame(rows, "key string, text string, truncated boolean, error string, read_at int")).collect()] == ["new"]


def test_order_of_words_is_checked():
    engines.check_order(lambda b: iter([(1, b.decode(), None)]), str.encode)
    with pytest.raises(ValueError, match="out of order"):
        engines.check_order(lambda b: iter([(1, " ".join(reversed(b.decode().split())), None)]), str.encode)


def test_settings_and_sheets(spark, tmp_path):
    assert readers.setting("K", {"K": " v "}) == "v" and readers.setting("K", {}, "# K=no\nexport K='w'\n") == "w" and readers.setting("K", {"K": ""}, "X=1") is None
    items = spark.createDataFrame([(2, "r1", "A", "q2", "b?", "<b>"), (1, "r2", "B", "q1", "a?", None)], "item int, run string, arm string, qid string, question string, answer string")
    page, labels, key = (open(p, encoding="utf-8").read() for p in sinks.labelling_sheet(items, str(tmp_path)))
    assert "&lt;b&gt;" in page and "r1" not in page and labels == "item,label,note\n1,,\n2,,\n" and key.splitlines()[0] == '{"item": 1, "run": "r2", "arm": "B", "qid": "q1"}'
    assert sinks.text_table(spark.createDataFrame([(1, "abc"), (22, None)], "n int, t string")) == "n   t\n1   abc\n22  -"


def test_rows_of_boxes():
    assert layout.line_rows([]) == [] and layout.line_rows([(0, 0, 50, 10), (60, 6, 70, 8)]) == [[0], [1]]
