import zipfile

import pytest
from pyspark.sql import functions as F

from warraq.operators import gold, stores
from warraq.sources import readers, sinks
from warraq.streaming import logs


def test_json_lines(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"k": 1}\n\n{"k": 2}\n{bad\n')
    rows = readers.checked_json_lines(spark, str(f), "k int").orderBy("line").collect()
    assert [(r.line, r.problem) for r in rows] == [(1, None), (3, None), (4, "{bad")]
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(f), "k int").collect()


def test_frequency_lists(spark, tmp_path):
    z = tmp_path / "w.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("w.tsv", "the\t9\nof\t5\nrare\t1\n")
        f.writestr("bad.tsv", "a\t1\nb\t2\n")
    assert [tuple(r) for r in readers.zipped_frequency_list(spark, str(z), "w.tsv", 5).collect()] == [("the", 9), ("of", 5)]
    with pytest.raises(Exception, match="descending"):
        readers.zipped_frequency_list(spark, str(z), "bad.tsv").collect()


def test_calendars_and_pages(spark):
    ics = "BEGIN:VEVENT\r\nDTSTART;VALUE=DATE:2026\r\n 0823\r\nDTEND;VALUE=DATE:20260825\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:20260901T080000\r\nDTEND:20260901T090000\r\nEND:VEVENT\r\n"
    rows = readers.ics_spans(spark.createDataFrame([("f", ics)], "file string, ics string")).orderBy("event").collect()
    assert [(str(r.first), str(r["last"])) for r in rows] == [("2026-08-23", "2026-08-24"), ("2026-09-01", "2026-09-01")]
    p = readers.form_feed_pages(spark.createDataFrame([("d", "one\ftwo\f ")], "doc_id string, text string"))
    assert [(r.page, r.text) for r in p.orderBy("page").collect()] == [(1, "one"), (2, "two")]


def test_truth_pieces_and_csv(spark, tmp_path):
    names = spark.createDataFrame([("a_p01.txt",), ("a_p01.csv",), ("b_p02_r1.txt",), ("c_p03.txt",), ("x.md",)], "name string")
    assert {r.name: r.kind for r in readers.truth_pieces(names).collect()} == {"a_p01.txt": "partial", "a_p01.csv": "table", "b_p02_r1.txt": "region", "c_p03.txt": "page"}
    (tmp_path / "l.csv").write_text("\ufeffitem,label\n1,CORRECT\n", encoding="utf-8")
    assert readers.csv_table(spark, str(tmp_path / "l.csv")).columns == ["item", "label"]


def test_parser_plug_in(spark, tmp_path):
    (tmp_path / "d.pdf").write_bytes(b"p1\fp2")
    (tmp_path / "e.pdf").write_bytes(b"!")

    def parse(content):
        if content == b"!":
            raise ValueError("not a document")
        return [(i, t, None) for i, t in enumerate(content.decode().split("\f"), 1)]

    rows = readers.pages(spark, str(tmp_path), parse).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.text, r.error) for r in rows] == [("d", 1, "p1", None), ("d", 2, "p2", None), ("e", None, None, "not a document")]
    with pytest.raises(ValueError):
        readers.page(spark.range(1), 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    with pytest.raises(ValueError):
        sinks.one_document(df, str(tmp_path / "o"))
    sinks.csv_table(df, str(tmp_path / "c"))
    assert readers.csv_table(spark, str(tmp_path / "c")).count() == 2
    assert sinks.markdown_table(df.orderBy("n")).splitlines()[2] == "| a | 1 |"
    assert df.limit(1).select(sinks.server_event(F.lit("answer"), F.struct("n"))).first()[0] == 'event: answer\ndata: {"n":1}\n\n'


def test_stores(spark):
    a = stores.keyed(spark.createDataFrame([("x",), ("y",), ("x",)], "t string"), "passage", "t")
    held = a.where("t = 'x'").select("key", F.lit(1.0).alias("score")).distinct()
    assert stores.missing(a, held).count() == 1 and stores.pruned(held, a.where("t = 'y'")).count() == 0
    with pytest.raises(Exception, match="not in the store"):
        stores.lookup(a, held, "score").collect()


def test_splits():
    groups = [("a", {"x": 2}), ("b", {"x": 1, "y": 1}), ("c", {"y": 2}), ("d", {"x": 1})]
    got = gold.choose_split(groups, {"x": 0.5, "y": 0.5}, 4, 50)
    parts = dict(groups)
    assert sum(sum(parts[g].values()) for g in got) == 4 and sum(parts[g].get("x", 0) for g in got) == 2


def test_stream_equals_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [(i, f"2026-01-01 00:{i:02d}:00", "ask" if i % 2 else "find", f"q {i} 5551234567") for i in range(30)]
    spark.createDataFrame(rows, "id int, at string, kind string, question string").select("id", F.col("at").cast("timestamp").alias("at"), "kind", "question").write.json(src)
    stream = spark.readStream.schema("id int, at timestamp, kind string, question string").json(src)
    logs.append(logs.accepted(stream), out, cp).awaitTermination(60)
    logged = spark.read.parquet(out)
    assert logged.count() == 30 and logged.where("question like '%555%'").count() == 0
    q = logs.by_hour(stream, "at", "kind").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = {tuple(r) for r in logs.by_hour(logged, "at", "kind").collect()}
    assert {tuple(r) for r in spark.table("hours").collect()} == batch


def test_limits_follow_what_was_allowed(spark):
    import datetime as dt
    import random

    rng, rows = random.Random(6), []
    for u in ("a", "b", None):
        t = 0
        for i in range(60):
            t += rng.choice([0, 1, 5, 20, 70])
            rows.append((len(rows), u, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp").repartition(4)
    want, let = {}, {}
    for e, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        own = let.setdefault(u, [])
        want[e] = sum((t - x).total_seconds() < 60 for x in own) < 3
        if want[e]:
            own.append(t)
    assert {r.event_id: r.allowed for r in logs.limited(df, "user", "ts", 3).collect()} == want
    assert logs.limited(df.limit(0), "user", "ts", 3).count() == 0


def test_requests_are_served_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    rows = [("r1", "2026-01-01T00:00:00Z", "call 0501234567890"), ("r1", "2026-01-01T00:00:01Z", "call 0501234567890"), ("r2", "2026-01-01T00:00:02Z", " "), ("r3", "2026-01-01T00:00:03Z", "who?")]
    spark.createDataFrame(rows, "request_id string, at string, question string").write.json(src)
    stream = spark.readStream.schema("request_id string, at timestamp, question string").json(src)
    told = []
    listener = logs.Progress(lambda batch, n: told.append(n))
    spark.streams.addListener(listener)
    answer = lambda df: df.withColumn("answer", F.concat(F.lit("re: "), "question"))
    logs.served(stream, answer, out, cp).awaitTermination(120)
    spark.streams.removeListener(listener)
    got = {r.request_id: r.answer for r in spark.read.parquet(out).collect()}
    assert got == {"r1": "re: call [redacted]", "r3": "re: who?"} and spark.read.parquet(out).count() == 2
    logs.served(stream, answer, out, cp).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_rolling_over_stretches(spark):
    import datetime as dt
    import random

    rng, t, rows = random.Random(8), 0, []
    for i in range(300):
        t += rng.choice([0, 30, 500, 1800])
        rows.append((i, rng.choice("ab"), dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), float(i)))
    df = spark.createDataFrame([*rows, (999, "a", None, 1.0)], "event_id long, user string, ts timestamp, v double").repartition(4)
    for seconds in (60, 3600, 7000):
        got = {r.event_id: (r.recent, r.recent_total) for r in logs.rolling(df, "user", "ts", "v", seconds).collect()}
        for i, u, at, _ in rows:
            near = [v for _, x, y, v in rows if x == u and 0 <= (at - y).total_seconds() <= seconds]
            assert got[i] == (len(near), round(sum(near), 4))
        assert got[999] == (1, 1.0)
