"""Token counts by an exact length histogram.

Documents are encoded with a byte-pair vocabulary of a given file and counted by their encoded length. Suffix sums over the lengths then answer, for every context limit at once: how many documents and tokens reach it, how many tokens remain when every document is truncated to it, and which share of the documents fits; quantiles are lengths at which that share is first reached.

The vocabulary file is read on the driver and shipped to the tasks; texts of any length are encoded whole.

Defined results: null and empty texts have length 0; special tokens' strings are ordinary text; repeated rows count each time; an empty table gives an empty histogram; no other column is read.

Plan: one scan; each task sums its own lengths, so that one row per length and task is shuffled. The suffix sums run over the distinct lengths: in ranges of lengths, by the sums of the ranges above.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, column, materialize, read

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths in a range of the suffix sums.
RANGE = 4096


def encoder(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """length, n_docs: partial counts of each task."""
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value, pattern)
        total: Counter[int] = Counter()
        for b in batches:
            total.update(len(enc.encode_to_numpy(t, disallowed_special=())) if (t := x.as_py()) else 0 for x in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["length", "n_docs"])

    return arrow_map(docs.select(column(docs, text).alias("text")), work, "length long, n_docs long")


def histogram(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """For each encoded length that occurs: n_docs, n_tokens, docs_at_least, tokens_at_least, truncated_tokens (all documents cut to it), docs_at_most, fits (the share of documents of at most that length)."""
    counts = materialize(lengths(docs, path, pattern, text).groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    rows = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("part", F.expr(f"length div {RANGE}"))
    inside = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row per RANGE lengths
    parts = parts.select("part", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    out = rows.join(parts, "part")
    docs_at_least = F.sum("n_docs").over(inside) + F.col("d_above")
    tokens_at_least = F.sum("n_tokens").over(inside) + F.col("t_above")
    out = out.withColumn("docs_at_least", docs_at_least).withColumn("tokens_at_least", tokens_at_least)
    at_most = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.select("length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"), at_most.alias("docs_at_most"), (at_most / F.col("all_docs")).alias("fits"))


def at_limits(found: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: n_docs that exceed or reach it, total tokens, and tokens after truncation to it."""
    each = [F.struct(F.lit(x).cast("long").alias("context"), F.sum(F.least("length", F.lit(x)) * F.col("n_docs")).alias("truncated_tokens"), F.sum(F.when(F.col("length") >= x, F.col("n_docs")).otherwise(0)).alias("docs_at_least"), F.sum("n_tokens").alias("n_tokens")) for x in limits]
    return found.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def quantiles(found: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that so many of the documents do not exceed."""
    each = [F.struct(F.lit(q).alias("share"), F.min(F.when(F.col("fits") >= q, F.col("length"))).alias("length")) for q in shares]
    return found.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums."""
    return histogram(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
