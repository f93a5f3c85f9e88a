"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of BLOCK_ROWS rows, in the order of a keyed content hash. Of a source of weight w (weights sum to one), block i (from 0) is released at floor(i / w) and due at ceil((i + 1) / w); at every slot the released block of the earliest deadline goes next. Every block then meets its deadline, so at any slot t before its last block a source has had less than one block more or less than w * t. Weights are exact fractions of the given numbers: release times and deadlines are whole-number arithmetic without rounding, at every size and for any number of sources. Past a source's last block its slots stay idle and the others go on in their proportions.

The mixture ends at the horizon: the slot at which the sources that have run out hold more than `tolerance` of the target weight (None: never). Documents beyond it have a slot and are marked as not in the mixture; `mixed` leaves them out. Mixing as a stage of the pipeline (`in_order`) returns every document in the order of the slots, the weights' part being the order alone; the sharding stage numbers each shard's slots in that order. Nothing is repeated.

Without given weights a source's target is its number of rows to the power EXPONENT (tempered sampling).

Defined results: null is a source of its own; a source without a given positive weight is not in the mixture (slot null); equal rows are interchangeable; an empty table gives no rows; null texts and ids count as any row; other columns pass through, packed, under any name.

Plan: one grouped count; its rows, one a source, go to a single task that simulates the schedule in a heap of one entry a source and streams one row a block, BLOCK_ROWS times fewer than documents (earliest deadline first has no parallel form). Ranks come from `common.ranked` (no source meets in one task) and meet the blocks in an equi-join on source and block. The driver holds nothing. `mixed` looks up the hash at which each source is cut; `in_order` joins the slots by content hash and sorts by them, two shuffles of the texts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, column, materialize, packed, ranked, read

BLOCK_ROWS, EXPONENT, TOLERANCE, SEED = 64, 0.7, 0.1, 6
#: Rows of the schedule that its task hands over at once, and the last time that a table can hold.
BATCH, LAST = 1 << 16, (1 << 63) - 1


def wholes(weights: dict[str, float]) -> dict[str, int]:
    """The same proportions as whole numbers, exactly."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[p.denominator for p in parts.values()])
    return {s: int(p * unit) for s, p in parts.items()}


def timetable(part: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block: earliest deadline first among the released; of equal deadlines, the source of the lesser name."""
    total = sum(part.values())
    times = lambda s, i: (i * total // part[s], -(-(i + 1) * total // part[s]))
    coming = [(*times(s, 0), s, 0) for s in part if blocks.get(s)]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])  # idle slots
        while coming and coming[0][0] <= slot:
            release, due, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, i, release))
        due, s, i, release = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a deadline was missed")
        yield s, i, release, due, slot
        if i + 1 < blocks[s]:
            heapq.heappush(coming, (*times(s, i + 1), s, i + 1))
        slot += 1


def horizon(part: dict[str, int], blocks: dict[str, int], tolerance: float | None) -> int | None:
    """First slot beyond the mixture; None without an end."""
    if tolerance is None:
        return None
    total, gone = sum(part.values()), 0
    for end, s in sorted((-(-blocks.get(s, 0) * total // a), s) for s, a in part.items()):
        gone += part[s]
        if gone > tolerance * total:
            return end
    return None


def blocks_of(counts: DataFrame, weights: dict[str, float] | None, block_rows: int, tolerance: float | None, exponent: float) -> DataFrame:
    """counts (s, n: rows of each source) -> s, block, release, deadline, slot, in_mix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {s: n for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        part = wholes({s: n**exponent for s, n in rows.items()} if weights is None else {s: w for s, w in weights.items() if w > 0})
        blocks = {s: -(-n // block_rows) for s, n in rows.items() if s in part}
        end = horizon(part, blocks, tolerance)
        some: list[tuple] = []
        for row in timetable(part, blocks):
            some.append((*row[:2], *(min(x, LAST) for x in row[2:]), end is None or row[-1] < end))
            if len(some) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some, strict=True)], NAMES)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some, strict=True)], NAMES)

    return arrow_map(counts.select("s", "n").coalesce(1), work, "s string, block long, release long, deadline long, slot long, in_mix boolean")


NAMES = ["s", "block", "release", "deadline", "slot", "in_mix"]


def source_key(source: str = "source"):
    """Null is a source of its own, apart from any text."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def scheduled(rows: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, tolerance: float | None = TOLERANCE, exponent: float = EXPONENT) -> DataFrame:
    """rows (s: source key, h: order hash; materialized) with rank, block, release, deadline, slot, in_mix. weights: by source key."""
    plan = materialize(blocks_of(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")), weights, block_rows, tolerance, exponent), "mix-blocks")
    plan = plan.withColumnRenamed("s", "__s").withColumnRenamed("block", "__block")
    placed = ranked(rows, ["s"], "h", "rank").withColumn("block", F.expr(f"rank div {block_rows}"))
    met = placed.join(plan, (F.col("s") == F.col("__s")) & (F.col("block") == F.col("__block")), "left").drop("__s", "__block")  # block_rows rows meet in a key
    return met.withColumn("in_mix", F.coalesce("in_mix", F.lit(False)))


def order_hash(docs: DataFrame):
    return F.xxhash64(F.lit(SEED), column(docs, "doc_id"), column(docs, "text"))


def whole_rows(docs: DataFrame, source: str) -> DataFrame:
    """row, __k (source key) and __h (order hash)."""
    return packed(docs).withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col("row")[source]), F.lit("null"))).withColumn("__h", F.xxhash64(F.lit(SEED), F.col("row.doc_id"), F.col("row.text")))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", **settings) -> DataFrame:
    """The documents of the mixture. Columns as before."""
    light = materialize(docs.select(source_key(source).alias("s"), order_hash(docs).alias("h")), "mix-rows")
    # The mixture holds each source's blocks up to the horizon, and a later block of a source never has an earlier slot, so one hash value cuts each source.
    cuts = materialize(scheduled(light, weights, **settings).where("in_mix").groupBy("s").agg(F.max("h").alias("cut")), "mix-cuts").withColumnRenamed("s", "__s")
    # A row per source: Spark broadcasts it while the written table is small, and splits skewed sources beyond that.
    return whole_rows(docs, source).join(cuts, (F.col("__k") == F.col("__s")) & (F.col("__h") <= F.col("cut"))).select("row.*")


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", **settings) -> DataFrame:
    """Every document, sorted by its slot; those of sources without a weight stand last. Columns as before."""
    light = materialize(docs.select(source_key(source).alias("s"), order_hash(docs).alias("h")), "mix-rows")
    # Rows of one source and one hash are interchangeable and stand together, at the first slot of any.
    slots = scheduled(light, weights, **settings).groupBy("s", "h").agg(F.min("slot").alias("slot"))
    slots = slots.select(F.col("s").alias("__s"), F.col("h").alias("__o"), F.coalesce("slot", F.lit(2**63 - 1)).alias("__slot"))
    met = whole_rows(docs, source).join(slots, (F.col("__k") == F.col("__s")) & (F.col("__h") == F.col("__o")))
    return met.orderBy("__slot", F.xxhash64(F.lit(SEED + 1), F.col("__s")), "__h").select("row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, rank, block, release, deadline, slot, in_mix for every document."""
    docs = read(spark, sf_dir, "documents")
    light = materialize(docs.select("doc_id", "source", source_key().alias("s"), order_hash(docs).alias("h")), "mix-rows")
    return scheduled(light).select("doc_id", "source", "rank", "block", "release", "deadline", "slot", "in_mix")
