"""Sharding (native): a hypergeometric communication matrix gives a uniform shuffle with exact shard sizes.

Rows fall into blocks by a hash of their content. How many rows of each block go to each shard is drawn exactly: a multivariate hypergeometric draw, block after block, from the shards' remaining room. Inside a block the rows are permuted by a keyed hash and dealt out by the drawn counts; in its shard each row is permuted again by another keyed hash, and its place is the slot. Every permutation of the rows is equally likely as far as the hashes are random, and shard sizes differ by one at most (law `rows`).

With `ordered`, the shards are dealt in the same way, but a row's slot is its rank in its shard by the order in which the table was written. The pipeline uses that: its shards hold the schedule of the mixing stage, each a uniform sample of the documents in the schedule's order, so what is read up to a slot has the target mixture, but for the draw.

The driver holds the matrix alone: MAX_BLOCKS x shards numbers whatever the input's size (with `ordered`, also a number a file). Ranks come from `common.ranked`, so no block, shard or group of copies meets in one task. Everything depends on content, seed and, with `ordered`, the written order, not on partitions, so a rerun after a lost executor deals the same.

Defined results: a null text has no bytes (size 1, CRC-32 0); null ids are hashed like any value; rows that are equal in id and text are interchangeable; an empty table gives no rows; further columns pass through, packed, under any name.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import in_written_order, json_table, materialize, packed, ranked, read

N_SHARDS = 16
SEED = 20
MAX_BLOCKS = 4096
#: Rows that a block has room for before the number of blocks grows; at MAX_BLOCKS blocks, they grow instead.
BLOCK_ROWS = 20_000


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """How many of `draws` rows out of good + bad are good: the inverse of the distribution function at u, by the ratios of neighbouring probabilities over 40 standard deviations around the mode."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mean = draws * good / total
    sd = math.sqrt(max(mean * (bad / total) * (total - draws) / max(1, total - 1), 0.25))
    a, b = max(low, math.floor(mean - 20 * sd - 20)), min(high, math.ceil(mean + 20 * sd + 20))
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(cdf, u * cdf[-1], side="right").clip(0, b - a))


def matrix(block_rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows of each block for each shard; sums by block are block_rows, sums by shard differ by one at most."""
    total = sum(block_rows)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng = np.random.default_rng(seed)
    out = []
    for n in block_rows:
        left, rest, row = n, sum(room), []
        for s in range(n_shards):
            rest -= room[s]
            x = hypergeometric(room[s], rest, left, rng.random())
            row.append(x)
            left -= x
        room = [r - x for r, x in zip(room, row, strict=True)]
        out.append(row)
    return out


def place(rows: DataFrame, n_shards: int, seed: int, tag: str = "shard") -> DataFrame:
    """rows with a long column __key (a content hash): adds __shard (int) and __slot (long). Slots go by __position (gapless from 0) where rows have it, else by a keyed hash."""
    spark = rows.sparkSession
    fine = {r.b: r.n for r in rows.groupBy(F.shiftrightunsigned("__key", 52).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_BLOCKS rows at most
    total = sum(fine.values())
    blocks = max(1, min(MAX_BLOCKS, total // BLOCK_ROWS))
    block = F.floor(F.shiftrightunsigned("__key", 52) * blocks / MAX_BLOCKS).cast("int")
    sizes = [0] * blocks
    for b, n in fine.items():
        sizes[b * blocks // MAX_BLOCKS] += n
    ends = [{"b": b, "ends": np.cumsum(row).tolist()} for b, row in enumerate(matrix(sizes, n_shards, seed))]
    dealt = ranked(rows.withColumn("__block", block).withColumn("__first", F.xxhash64(F.lit(seed), F.col("__key"))), ["__block"], "__first", "__rank", bits=2)
    dealt = dealt.join(F.broadcast(json_table(spark, json.dumps(ends), "b:int,ends:array<bigint>")), F.col("__block") == F.col("b"))
    dealt = dealt.withColumn("__shard", F.size(F.filter("ends", lambda e: e <= F.col("__rank"))).cast("int"))
    # Positions are spread over all leading bits, by which ranks are cut.
    dealt = dealt.withColumn("__second", F.shiftleft("__position", 63 - total.bit_length()) if "__position" in rows.columns else F.xxhash64(F.lit(seed + 1), F.col("__key")))
    dealt = materialize(dealt.drop("__block", "__first", "__rank", "b", "ends", "__position"), tag)
    return ranked(dealt, ["__shard"], "__second", "__slot").drop("__second")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, ordered: bool = False) -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard; with `ordered`, in the order in which docs was written). Columns of docs by these names give way to the new ones."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = in_written_order(docs) if ordered else packed(docs)
    kept = F.struct(*[F.col("row")[c].alias(c) for c in names]).alias("row")
    rows = rows.select(kept, F.xxhash64(F.col("row.doc_id"), F.col("row.text")).alias("__key"), *[c for c in rows.columns if c == "__position"])
    return place(rows, n_shards, seed, "shards").select("row.*", F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("__key"))
    placed = place(materialize(light, "shard-rows"), N_SHARDS, SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
