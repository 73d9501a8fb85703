"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order that a hash of doc_id gives, are cut into blocks. In units of one block, block j of a source of share w may go out from
time ``floor(j / w)`` and must be out by ``ceil((j + 1) / w)``; in each slot the open block of the earliest deadline goes. So at any time a source has less
than one block more or fewer than its share. Shares are exact fractions, windows are whole numbers worked out for any j.

When a source has sent its last block, a phase ends at that slot, and the others begin anew by their own weights: counted from there, each has less than one block
more or fewer than its share among those that are left. No slot is empty, and no document is left behind.

A phase's time is cut into stretches, which tasks schedule apart from one another, given how many blocks each source has sent before; where they are cut doesn't
matter for the schedule. Weights that are whole parts of a sum of at most PERIOD meet their shares exactly each time that so many slots have passed: stretches begin
there, and the driver goes through the last of these periods to find the phase's end (2 microseconds a slot, a phase for each source that ends). For other weights (1
to pi, say) no such time may come while there are documents; then one pass over the slots notes what has been sent at the stretches' ends.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast, durable

#: Slots of a stretch at least, and the longest period of weights (or so many slots a source) at which stretches begin.
STRETCH, PERIOD, PERIOD_PER_SOURCE = 4096, 1 << 20, 256
#: Whole parts of 1 that a weight by a source's size has.
PARTS = 64
#: Documents that a bucket of a source has, about, when documents are numbered; blocks that go out of a task at once.
BUCKET_DOCS, BATCH_BLOCKS = 2_000, 1 << 15


class Shares:
    """Exact shares of some sources, and the schedule that they give for any stretch of time."""

    def __init__(self, weights: list[Fraction]) -> None:
        if any(w <= 0 for w in weights):
            raise ValueError("weights must be positive")
        scale = lcm(*(w.denominator for w in weights))
        parts = [int(w * scale) for w in weights]
        self.parts = [p // gcd(*parts) for p in parts]
        self.total = sum(self.parts)
        self.periodic = self.total <= max(PERIOD, PERIOD_PER_SOURCE * len(weights))
        self.stretch = -(-STRETCH // self.total) * self.total if self.periodic else max(STRETCH, PERIOD_PER_SOURCE * len(weights))

    def release(self, s: int, j: int) -> int:
        return j * self.total // self.parts[s]

    def deadline(self, s: int, j: int) -> int:
        return -(-(j + 1) * self.total // self.parts[s])

    def slots(self, start: int, end: int, sent: list[int]) -> Iterator[tuple[int, int]]:
        """(source, block) of each slot from start, when sources have sent so many blocks: earliest deadline first among released blocks."""
        coming, ready = [(self.release(s, j), s, j) for s, j in enumerate(sent)], []
        heapq.heapify(coming)
        for t in range(start, end):
            while coming and coming[0][0] <= t:
                _, s, j = heapq.heappop(coming)
                heapq.heappush(ready, (self.deadline(s, j), s, j))
            _, s, j = heapq.heappop(ready)
            heapq.heappush(coming, (self.release(s, j + 1), s, j + 1))
            yield s, j

    def first_end(self, n: list[int]) -> tuple[int, list[int], list[list[int]]]:
        """(slots until the first source has sent its n[s] blocks, what each has sent by then, what each has sent before each stretch if weights have no period)."""
        start = min(self.release(s, k - 1) for s, k in enumerate(n)) // self.total * self.total if self.periodic else 0
        sent, states = [p * (start // self.total) for p in self.parts], []
        end = min(self.deadline(s, k - 1) for s, k in enumerate(n))
        for t, (s, j) in enumerate(self.slots(start, end, sent), start):
            if not self.periodic and t % self.stretch == 0:
                states.append(list(sent))
            sent[s] = j + 1
            if j + 1 == n[s]:
                return t + 1, sent, states
        raise AssertionError("a block missed its deadline")

    def stretch_slots(self, k: int, stop: int, states: list[list[int]]) -> Iterator[tuple[int, int]]:
        start = k * self.stretch
        return self.slots(start, min(start + self.stretch, stop), [p * (start // self.total) for p in self.parts] if self.periodic else states[k])


def phases(blocks: dict[str, int], weights: dict[str, Fraction]) -> list[tuple[np.ndarray, int, int, list[list[int]]]]:
    """(blocks that each source, by name, has sent before, slots, stretches, states) of each phase: a number for each source and phase; if weights have no period, also
    one for each source and stretch."""
    names, done, out = sorted(blocks), dict.fromkeys(blocks, 0), []
    while left := [s for s in names if blocks[s] > done[s]]:
        shares = Shares([weights[s] for s in left])
        stop, sent, states = shares.first_end([blocks[s] - done[s] for s in left])
        out.append((np.array([done[s] for s in names]), stop, -(-stop // shares.stretch), states))
        for s, k in zip(left, sent):
            done[s] += k
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, source, number): each source's documents from 0 in the order of a hash; no source is in one task.

    A source is cut into buckets by the hash's range; documents are numbered within a bucket, after those of the buckets before.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(-1))))
    sizes = durable(keyed.groupBy("source").count(), "sizes")
    spread = sizes.select("source", F.ceil(F.col("count") / BUCKET_DOCS).cast("long").alias("buckets"))
    keyed = keyed.join(checked_broadcast(spread), "source").withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    counts = keyed.groupBy("source", "bucket").count()
    ahead = F.sum("count").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    counts = durable(counts.select("source", "bucket", ahead.alias("ahead")), "buckets")
    nth = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")) - 1
    return keyed.withColumn("nth", nth).join(checked_broadcast(counts), ["source", "bucket"]).select("doc_id", "source", (F.col("nth") + F.col("ahead")).alias("number"))


def scheduled(spark: SparkSession, sizes: dict[str, int], weights: dict[str, Fraction], block_docs: int) -> DataFrame:
    """(source, block, stretch, slot, before, size) of each block: size documents, after before others in its stretch. Each task schedules some stretches."""
    names, blocks = sorted(sizes), {s: -(-n // block_docs) for s, n in sizes.items()}
    plan = phases(blocks, weights)
    first = [0]
    for _, _, stretches, _ in plan:
        first.append(first[-1] + stretches)
    shared = spark.sparkContext.broadcast((plan, first, sizes, weights))

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), *[pa.int64()] * 5)
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["source", "block", "stretch", "nth", "before", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, first, sizes, weights = shared.value
        for batch in batches:
            for stretch in batch.column("stretch").to_pylist():
                phase = bisect_right(first, stretch) - 1
                done, stop, _, states = plan[phase]
                left = [(s, k) for s, k in zip(names, done.tolist()) if k < blocks[s]]
                shares = Shares([weights[s] for s, _ in left])
                rows, before = [], 0
                for nth, (i, j) in enumerate(shares.stretch_slots(stretch - first[phase], stop, states)):
                    source, block = left[i][0], left[i][1] + j
                    size = min(block_docs, sizes[source] - block * block_docs)
                    rows.append((source, block, stretch, nth, before, size))
                    before += size
                    if len(rows) == BATCH_BLOCKS:
                        yield as_batch(rows)
                        rows = []
                yield as_batch(rows)

    every = spark.range(first[-1], numPartitions=max(1, min(first[-1], 10_000))).withColumnRenamed("id", "stretch")
    return every.mapInArrow(run, "source string, block long, stretch long, nth long, before long, size long")


def as_fraction(weight: float | Fraction) -> Fraction:
    """A number as it is written: 0.3 is three tenths."""
    return weight if isinstance(weight, Fraction) else Fraction(str(weight))


def mix(docs: DataFrame, weights: dict[str, float | Fraction] | None = None, block_docs: int = 16) -> DataFrame:
    """(doc_id, source, block, slot, position) for each row of docs (doc_id, source): slots are in order of output, position counts documents from 0.

    Weights are by source, positive, and taken as they are written; one that has none, or all if none are given, gets the square root of its number of documents
    over all sources' mean, in whole parts of PARTS (one at least). A null source is the source ''. Repeated rows and null ids are documents like others. No
    rows give no rows. The driver gets one row for each source, and keeps a number for each source and phase, of which there are as many as sources (for each source and
    stretch too, if the weights have no period).
    """
    spark = docs.sparkSession
    rows = durable(numbered(docs), "numbered")
    n = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    roots = {s: k**0.5 for s, k in n.items()}
    mean = sum(roots.values()) / max(1, len(roots))
    given = {s: as_fraction(weights[s]) if s in (weights or {}) else Fraction(max(1, round(PARTS * root / mean)), PARTS) for s, root in roots.items()}
    placed = durable(scheduled(spark, n, given, block_docs), "placed")
    stretches = placed.groupBy("stretch").agg(F.sum("size").alias("docs"), F.count(F.lit(1)).alias("blocks"))
    # one row for each stretch of thousands of blocks
    order = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = stretches.select("stretch", (F.sum("docs").over(order) - F.col("docs")).alias("docs_ahead"), (F.sum("blocks").over(order) - F.col("blocks")).alias("blocks_ahead"))
    placed = placed.join(checked_broadcast(durable(ahead, "ahead")), "stretch")
    placed = placed.select("source", "block", (F.col("blocks_ahead") + F.col("nth")).alias("slot"), (F.col("docs_ahead") + F.col("before")).alias("first"))
    rows = rows.withColumn("block", F.expr(f"number div {block_docs}")).join(placed, ["source", "block"])
    return rows.select("doc_id", "source", "block", "slot", (F.col("first") + F.col("number") % block_docs).alias("position"))
