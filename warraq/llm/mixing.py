"""Sources mixed to target weights (problem 7).

Documents of the same text are one item, a member of every source that holds it;
items with the same set of sources make a membership pattern.  Spark sums tokens
by pattern; on the driver stays a flow network of patterns and sources: tokens go
from the start over a pattern's repetition levels (its tokens once at cost 0, a
second time at cost 1, and so on: convex) to the quotas of its sources.  The
min-cost maximum flow gives how many tokens of each pattern go to each source.
An item serves a source at most ``max_repeats`` times, and altogether at most as
often as the most generous of its sources allows.

Items of a pattern are laid along a tape in an order drawn from the seed, level
after level, and the flows along the same tape; an item's use belongs to the flow
in which it begins.  Places on the tape come from sums over ``BUCKETS`` of the
seed's hash and a running sum within a bucket, so no pattern is sorted in one task.

``total`` is the size aimed at; by default the largest at which every listed
source that has documents gets its share.  A source without documents gets none,
and with a ``total`` above the default others may fall short too: nothing else is
stretched for them, and ``shares`` reports what was reached.

The patterns on the driver are sets of listed sources: at most ``PATTERNS``, else
an error says so.  Null texts, and documents without tokens, take no part.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import TOKENIZER, sized

BUCKETS, PATTERNS, SEED = 4096, 20_000, 17


class Flow:
    """Tokens from patterns to sources, up to the sources' quotas: a flow network of which only what patterns give has a cost.

    As only the edges into patterns cost, a path's cost is the level that it starts with: maximum flows level by level, each
    on what the last one left, are a maximum flow of least cost.  Every level is blocked by shortest paths (Dinic).
    """

    def __init__(self, patterns: list[tuple[tuple[str, ...], int]], sources: list[str], quotas: list[int], limits: list[int]):
        at = {s: i for i, s in enumerate(sources)}
        self.members = [[at[s] for s in p] for p, _ in patterns]
        self.most = [[tokens * limits[j] for j in m] for (_, tokens), m in zip(patterns, self.members)]
        self.sent = [[0] * len(m) for m in self.members]
        self.given = [0] * len(patterns)  # what a pattern may still give at this level
        self.wanted = list(quotas)
        self.holders: list[list[tuple[int, int]]] = [[] for _ in sources]
        for p, m in enumerate(self.members):
            for k, j in enumerate(m):
                self.holders[j].append((p, k))

    def level(self, capacities: list[int]) -> None:
        """Let every pattern give up to its capacity more, and send as much as can be sent."""
        self.given = list(capacities)
        while self._grade():
            self.next_source = [0] * len(self.members)
            self.next_pattern = [0] * len(self.wanted)
            for p in range(len(self.members)):
                while self.given[p] and (n := self._push(p, self.given[p])):
                    self.given[p] -= n

    def _grade(self) -> bool:
        """Distances from the patterns that can give: over free edges to sources, and back over edges that carry something."""
        self.far_p = [0 if g else -1 for g in self.given]
        self.far_s = [-1] * len(self.wanted)
        now, step, reached = [p for p, g in enumerate(self.given) if g], 0, False
        while now and not reached:
            found = []
            for p in now:
                for k, j in enumerate(self.members[p]):
                    if self.far_s[j] < 0 and self.sent[p][k] < self.most[p][k]:
                        self.far_s[j] = step + 1
                        found.append(j)
                        reached = reached or self.wanted[j] > 0
            now, step = [], step + 2
            for j in found:
                for p, k in self.holders[j]:
                    if self.far_p[p] < 0 and self.sent[p][k]:
                        self.far_p[p] = step
                        now.append(p)
        return reached

    def _push(self, p: int, n: int) -> int:
        m = self.members[p]
        while self.next_source[p] < len(m):
            k = self.next_source[p]
            j = m[k]
            if self.far_s[j] == self.far_p[p] + 1 and (free := min(n, self.most[p][k] - self.sent[p][k])) > 0:
                if pushed := min(free, self.wanted[j]):
                    self.wanted[j] -= pushed
                    self.sent[p][k] += pushed
                    return pushed
                while self.next_pattern[j] < len(self.holders[j]):
                    q, i = self.holders[j][self.next_pattern[j]]
                    if self.far_p[q] == self.far_s[j] + 1 and self.sent[q][i] and (pushed := self._push(q, min(free, self.sent[q][i]))):
                        self.sent[q][i] -= pushed
                        self.sent[p][k] += pushed
                        return pushed
                    self.next_pattern[j] += 1
            self.next_source[p] += 1
        return 0


def _network(patterns: list, targets: list[tuple[str, float, int]], total: int) -> tuple[Flow, list[int]]:
    limits = [max(0, r) for _, _, r in targets]
    flow = Flow(patterns, [s for s, _, _ in targets], [round(share * total) for _, share, _ in targets], limits)
    return flow, [max(limits[j] for j in m) for m in flow.members]


def route(patterns: list[tuple[tuple[str, ...], int]], targets: list[tuple[str, float, int]], total: int) -> list[tuple[tuple[str, ...], str, int]]:
    """(pattern, source, tokens) of the best flow; ``targets``: (source, share, max_repeats)."""
    flow, most = _network(patterns, targets, total)
    for level in range(max(most, default=0)):
        flow.level([tokens if level < m else 0 for (_, tokens), m in zip(patterns, most)])
    return [(p, s, n) for (p, _), sent in zip(patterns, flow.sent) for s, n in zip(p, sent) if n]


def reachable(patterns: list[tuple[tuple[str, ...], int]], targets: list[tuple[str, float, int]]) -> int:
    """The largest total, to a ten-thousandth, at which every source that has documents gets its share."""
    held = {s for p, _ in patterns for s in p}
    own = [t for t in targets if t[0] in held and t[1] > 0 and t[2] > 0]
    names = {s for s, _, _ in own}
    kept = [(q, n) for p, n in patterns if (q := tuple(s for s in p if s in names))]

    def holds(total: int) -> bool:
        flow, most = _network(kept, own, total)
        flow.level([n * m for (_, n), m in zip(kept, most)])
        return not any(flow.wanted)

    # no source can give more than its documents as often as they may be used
    low, high = 0, min((int(sum(n for p, n in kept if s in p) * r / share) + 1 for s, share, r in own), default=0)
    while high - low > max(1, high // 10_000):
        middle = (low + high) // 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def listed(targets: DataFrame) -> DataFrame:
    """The targets, each source once."""
    return targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("int").alias("max_repeats"))


def select(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, uses, n_tokens): the documents selected for each source and how often each is used."""
    spark = documents.sparkSession
    rows = [(r.source, r.target_share, r.max_repeats) for r in listed(targets).orderBy("source").collect()]  # a fixed, small table
    empty = spark.createDataFrame([], "doc_id long, source string, uses int, n_tokens long")
    if not rows:
        return empty
    own = documents.where(F.col("source").isin([s for s, _, _ in rows])).where("text is not null")
    sizes = sized(own.withColumn("same", F.sha2("text", 256)), path, curve=False, keep=("source", "same")).where("n_tokens > 0")
    # one document stands for each text in each of its sources
    members = sizes.groupBy("same", "source").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens")).persist(StorageLevel.DISK_ONLY)
    items = members.groupBy("same").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.first("n_tokens").alias("n_tokens"))
    items = items.withColumn("draw", F.xxhash64(F.lit(seed), "same")).withColumn("bucket", F.pmod("draw", F.lit(BUCKETS))).persist(StorageLevel.DISK_ONLY)
    by_bucket = items.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("tokens")).persist(StorageLevel.DISK_ONLY)
    sums = by_bucket.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(PATTERNS + 1).collect()
    if len(sums) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    patterns = sorted((tuple(r.pattern), r.tokens) for r in sums)
    if not patterns:
        return empty
    total = total if total is not None else reachable(patterns, rows)
    flows = route(patterns, rows, total)
    at: dict[tuple[str, ...], int] = {}
    intervals = []
    for p, s, n in flows:
        a = at.get(p, 0)
        intervals.append((p, s, a, a + n))
        at[p] = a + n
    if not intervals:
        return empty
    tokens = dict(patterns)
    tape = spark.createDataFrame([(list(p), s, a, b, tokens[p]) for p, s, a, b in intervals], "pattern array<string>, source string, a long, b long, length long")
    before = by_bucket.select("pattern", "bucket", (F.sum("tokens").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("tokens")).alias("before"))
    within = Window.partitionBy("pattern", "bucket").orderBy("draw", "same").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, ["pattern", "bucket"])
    # uses of an item by a flow: how many of its places (one a level) fall into the flow's stretch [a, b)
    start = F.col("before") + F.col("inner")
    up_to = lambda x: F.greatest(F.ceil((x - start) / F.col("length")), F.lit(0))
    used = placed.join(F.broadcast(tape), "pattern").select("same", "source", (up_to(F.col("b")) - up_to(F.col("a"))).cast("int").alias("uses")).where("uses > 0")
    return used.join(members, ["same", "source"]).select("doc_id", "source", "uses", "n_tokens")


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, share, of_aim, most_uses): what each listed source reached.

    ``share`` is of all tokens selected, ``of_aim`` of what these would be had every source without documents got its share too.
    """
    per = selected.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    got = listed(targets).join(per, "source", "left").fillna(0, ["documents", "tokens", "most_uses"])
    listed_rows = Window.partitionBy(F.lit(0))  # a row per listed source
    total, met = F.sum("tokens").over(listed_rows), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(listed_rows)
    return got.select("source", "target_share", "documents", "tokens", F.when(total > 0, F.round(F.col("tokens") / total, 6)).alias("share"), F.when(total > 0, F.round(F.col("tokens") / total * met, 6)).alias("of_aim"), "most_uses")
