"""Requests as a stream: cleaned, kept once, counted by hour, by outcome and by the last minute.

Late data: a watermark of ten minutes, ours to choose; state is dropped beyond it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.text import redact

WATERMARK = "10 minutes"
MOST_CHARS = 500


def accepted(requests: DataFrame, column: str = "question") -> DataFrame:
    """Requests of 1 to 500 characters, trimmed, with personal data taken out before anything is kept."""
    own = F.trim(F.col(column))
    return requests.where(F.length(own).between(1, MOST_CHARS)).withColumn(column, redact(own))


def once(requests: DataFrame, key: str, at: str) -> DataFrame:
    """Requests whose key was not seen within the watermark."""
    return requests.withWatermark(at, WATERMARK).dropDuplicatesWithinWatermark([key])


def by_hour(events: DataFrame, at: str, *by: str) -> DataFrame:
    """Counts a tumbling hour."""
    own = events.withWatermark(at, WATERMARK) if events.isStreaming else events
    return own.groupBy(F.window(at, "1 hour").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), *by, "n")


def by_minute(events: DataFrame, at: str, *by: str, length: str = "60 seconds", slide: str = "15 seconds") -> DataFrame:
    """Counts in sliding windows."""
    own = events.withWatermark(at, WATERMARK) if events.isStreaming else events
    return own.groupBy(F.window(at, length, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def counters(events: DataFrame, by: str, value: str, bounds: tuple[float, ...] = (1, 5, 10, 50)) -> DataFrame:
    """Counts, sums and a cumulative histogram by outcome."""
    cols = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    return events.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), *cols)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log in Parquet: what is there now is written, then the query ends."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def rolling(events: DataFrame, key: str, at: str, value: str, seconds: int = 60) -> DataFrame:
    """Each event with the number and sum of its key's events in the last seconds, itself included.

    Batch and exact.  A key's time is cut into stretches of an hour (or of the seconds, if they are more), each read with the
    one before it, so a key with most of the events is spread; events without a time or key are as a range window has them.
    """
    from pyspark.sql import Window

    length = max(seconds, 3600) * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    own = events.withColumn("_us", us).withColumn("_own", F.floor(F.col("_us") / length))
    # an event belongs to its stretch, and is looked back on from the next
    each = own.withColumn("_stretch", F.explode_outer(F.when(F.col("_own").isNotNull(), F.array(F.col("_own"), F.col("_own") + 1))))
    w = Window.partitionBy(key, "_stretch").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    counted = each.withColumn("recent", F.count("*").over(w)).withColumn("recent_total", F.round(F.sum(value).over(w), 4))
    return counted.where(F.col("_stretch").eqNullSafe(F.col("_own"))).drop("_us", "_own", "_stretch")


def replayed(requests: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered from the store, still to ask) of requests by key."""
    return requests.join(store, "key"), requests.join(store.select("key"), "key", "left_anti")


def limited(events: DataFrame, key: str, at: str, most: int, seconds: int = 60, event: str = "event_id") -> DataFrame:
    """Adds ``allowed``: whether a key's event comes when under ``most`` of its events were allowed in the seconds before.

    What is allowed depends on what was, but not across a pause of ``seconds`` or more, so a key's events are read in
    stretches between pauses, each by one task; ties in time go by the event's id.  A null key is a key.
    """
    from pyspark.sql import Window

    us = F.unix_micros(F.col(at).cast("timestamp"))
    order = Window.partitionBy(key).orderBy("_us", event)
    own = events.withColumn("_us", us)
    pause = F.coalesce(F.col("_us") - F.lag("_us").over(order) >= seconds * 1_000_000, F.lit(True))
    own = own.withColumn("_pause", pause).withColumn("_stretch", F.sum(F.col("_pause").cast("int")).over(order))
    kind = dict(events.dtypes)[event]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        let: deque[int] = deque()
        rows = []
        for e, t in sorted(zip(pdf[event], pdf["_us"]), key=lambda x: (x[1], x[0])):
            while let and t - let[0] >= seconds * 1_000_000:
                let.popleft()
            rows.append((e, len(let) < most))
            if rows[-1][1]:
                let.append(t)
        return pd.DataFrame(rows, columns=[event, "allowed"])

    return events.join(own.select(key, "_stretch", event, "_us").groupBy(key, "_stretch").applyInPandas(run, f"{event} {kind}, allowed boolean"), event)


def served(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "request_id", at: str = "at") -> StreamingQuery:
    """Requests of a stream accepted, kept once, answered batch by batch and logged; what is there now is served, then the query ends.

    ``answer`` takes a batch of requests and gives the rows to log.  A batch that is tried again after a failure writes
    over what it wrote, so every request is logged once.
    """

    def batch(df: DataFrame, number: int) -> None:
        answer(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once(accepted(requests), key, at).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls ``tell(batch, rows)`` after each batch of any stream of the session."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
