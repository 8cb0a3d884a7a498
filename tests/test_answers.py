import json

from pyspark.sql import functions as F

from warraq.operators import answers


def one(spark, value, made):
    return spark.createDataFrame([(value,)], "t string").select(made(F.col("t")).alias("x")).first().x


def test_service_replies(spark):
    body = {"candidates": [{"content": {"parts": [{"text": "thinking", "thought": True}, {"text": "Yes "}, {"text": "[1]."}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 3}}
    assert tuple(one(spark, json.dumps(body), answers.reply)) == ("Yes [1].", "STOP", 5, 3, 0)
    assert one(spark, '{"promptFeedback": {"blockReason": "OTHER"}}', answers.reply).finish == "BLOCKED: OTHER"
    assert one(spark, "{}", answers.reply).finish == "NO_CANDIDATE"


def test_retry_delays(spark):
    assert one(spark, '{"retryDelay": "3.5s"}', answers.retry_delay) == 3.5
    assert abs(one(spark, "Please retry in 1h2m3.4s.", answers.retry_delay) - 3723.4) < 1e-9
    assert one(spark, "none", answers.retry_delay) is None and one(spark, None, answers.retry_delay) is None


def test_verdicts_and_labels(spark):
    assert one(spark, "VERDICT: partial, no: Verdict - **Correct**", answers.verdict) == "CORRECT"
    assert one(spark, "none", answers.verdict) is None
    assert one(spark, " w ", answers.hand_label) == "WRONG" and one(spark, "x", answers.hand_label) is None


def test_citations_against_evidence(spark):
    df = spark.createDataFrame([("see [1], [3] and [9]", ["a", "b", "c"], [["a"], ["z"]])], "t string, sources array<string>, holders array<array<string>>")
    c = answers.cited(F.col("t"), F.col("sources"))
    r = df.select(c.alias("c"), answers.citation_measures(answers.cited_sources(c["known"], F.col("sources")), F.col("holders")).alias("m")).first()
    assert (r.c.known, r.c.unknown, r.m.precision, r.m.recall) == ([1, 3], [9], 0.5, 0.5)


def test_readable_ranges(spark):
    assert one(spark, "2026/12/31-20م", answers.readable_ranges) == "2026/12/20 - 2026/12/31م"
    assert one(spark, "2026/12/31", answers.readable_ranges) == "2026/12/31"
