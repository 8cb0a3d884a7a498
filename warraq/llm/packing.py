"""Documents put whole into containers of fixed capacity (problem 6).

A document's distinct tokens are hashed to directions and projected to a few
dimensions; its cell there gives a key on the Hilbert curve.  Documents are
range-sorted by (kind, key, doc_id), so a task holds a stretch of the curve, and
neighbours are packed together: of a window of neighbours the largest comes
first into the fullest container that takes it (best fit decreasing).  Containers
filled to ``CLOSED`` are done; the rest of the window's documents go on into the
next window, for ``CARRIED`` windows at most.  What a stretch then leaves, or
leaves at its end, is packed again with what the stretches beside it leave, so
unused space doesn't grow with the number of tasks; in that round containers are
closed as they stand after as many windows.

A document longer than the capacity is cut; its full pieces fill containers of
their own and only its last piece is packed.  Between two items of a container
stand ``separator_tokens``.

Only (doc_id, size, key) is shuffled, never a text; equal keys are parted by
doc_id, so any number of copies is spread.  Documents without tokens take no
space and are in no container; kinds without a positive capacity are left out.
Copies of a document (same id) count once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, sized

#: Documents of a window, and the share of its capacity at which a container is closed within the stretch.
WINDOW, CLOSED = 4096, 0.995
#: Stretches whose ends are packed together, and windows whose documents a task holds at most.
JOINED, CARRIED = 32, 4

PLACED = "container_kind string, container_id string, doc_id long, piece_no int, n_tokens long"


def best_fit(items: list[tuple[int, int, int]], capacity: int, separator: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Containers as (tokens used, items), of items (n_tokens, doc_id, piece_no): largest first into the fullest that takes it."""
    room: list[tuple[int, int]] = []  # (free for a further item and its separator, container)
    bins: list[list[tuple[int, int, int]]] = []
    for item in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        need = item[0] + separator
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(item)
        else:
            free, b = capacity + separator, len(bins)
            bins.append([item])
        if free - need > separator:
            insort(room, (free - need, b))
    return [(sum(i[0] for i in b) + separator * (len(b) - 1), b) for b in bins]


def _pack(rows: DataFrame, last: bool) -> DataFrame:
    """Pack each task's stretch; in the first round what isn't closed at the end comes back without a container."""
    import pyarrow as pa

    names = ["container_kind", "container_id", "doc_id", "piece_no", "n_tokens", "key", "capacity", "separator"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        out: list[tuple] = []
        held: list[tuple[int, int, int]] = []
        keys: dict[tuple[int, int], int] = {}
        now: tuple | None = None

        def give(items, name):
            kind, capacity, separator = now
            out.extend((kind, name, d, p, n, keys.pop((d, p)), capacity, separator) for n, d, p in items)

        def pack(end: bool) -> None:
            nonlocal held
            if not held:
                return
            kind, capacity, separator = now
            waiting = []
            for used, items in best_fit(held, capacity, separator):
                if used >= CLOSED * capacity or end and last:
                    give(items, f"{kind}:{items[0][1]}:{items[0][2]}")
                elif end:
                    give(items, None)
                else:
                    waiting.extend(items)
            held = waiting

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return batch

        fresh = 0
        for b in batches:
            for kind, doc, piece, n, key, capacity, separator in zip(*(b.column(k).to_pylist() for k in ("container_kind", "doc_id", "piece_no", "n_tokens", "key", "capacity", "separator"))):
                if now != (kind, capacity, separator):
                    pack(True)
                    held, fresh, now = [], 0, (kind, capacity, separator)
                held.append((n, doc, piece))
                keys[doc, piece] = key
                if (fresh := fresh + 1) >= WINDOW:
                    pack(False)
                    fresh = 0
                    if len(held) > CARRIED * WINDOW:  # what fills no container here goes on to the next round, or is as full as it gets
                        pack(True)
                        held = []
            if len(out) >= 20_000:
                yield flush()
        if now:
            pack(True)
        if out:
            yield flush()

    schema = "container_kind string, container_id string, doc_id long, piece_no int, n_tokens long, key long, capacity long, separator long"
    return rows.select("container_kind", "doc_id", "piece_no", "n_tokens", "key", "capacity", "separator").mapInArrow(run, schema)


def stretched(rows: DataFrame, tasks: int) -> DataFrame:
    order = ["container_kind", "key", "doc_id", "piece_no"]
    return rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def pack(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER, tasks: int | None = None) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, n_tokens): where every document, or piece of one, goes."""
    spark = documents.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = sized(documents, path).where("n_tokens > 0").dropDuplicates(["doc_id"]).persist(StorageLevel.DISK_ONLY)
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(
        F.max("capacity_tokens").cast("long").alias("capacity"), F.max(F.coalesce("separator_tokens", F.lit(0))).cast("long").alias("separator")
    )
    # a row per document and kind: the kinds are a fixed handful, so their list travels with each document
    listed = [r.asDict() for r in kinds.orderBy("container_kind").collect()]
    kind = F.explode(F.array(*(F.struct(F.lit(k["container_kind"]).alias("container_kind"), F.lit(k["capacity"]).alias("capacity"), F.lit(k["separator"]).alias("separator")) for k in listed))) if listed else None
    if kind is None:
        return spark.createDataFrame([], PLACED)
    each = sizes.select("doc_id", "n_tokens", "key", kind.alias("k")).select("doc_id", "n_tokens", "key", "k.*")
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    whole = each.where(full > 0).select("container_kind", "doc_id", F.explode(F.sequence(F.lit(1), full)).alias("piece_no"), F.col("capacity").alias("n_tokens"))
    whole = whole.select("container_kind", F.concat_ws(":", "container_kind", "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", "n_tokens")
    rest = each.withColumns({"piece_no": full + 1, "n_tokens": F.col("n_tokens") % F.col("capacity")}).where("n_tokens > 0")
    first = _pack(stretched(rest, tasks), last=False).persist(StorageLevel.DISK_ONLY)
    left = first.where("container_id is null")
    second = _pack(stretched(left, max(1, tasks // JOINED)), last=True)
    names = ["container_kind", "container_id", "doc_id", "piece_no", "n_tokens"]
    return whole.unionByName(first.where("container_id is not null").select(*names)).unionByName(second.select(*names))


def fill(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, containers, items, tokens, fill): how full each kind's containers are, separators counted as used."""
    per = placed.groupBy("container_kind", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return (
        per.join(containers.select("container_kind", "capacity_tokens", "separator_tokens"), "container_kind")
        .groupBy("container_kind")
        .agg(
            F.count("*").alias("containers"),
            F.sum("items").alias("items"),
            F.sum("tokens").alias("tokens"),
            F.round(F.sum(F.col("tokens") + (F.col("items") - 1) * F.col("separator_tokens")) / F.sum("capacity_tokens"), 6).alias("fill"),
        )
    )
