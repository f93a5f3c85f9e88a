"""SimHash near-dedup by segment-popcount embedding.

A 64-bit fingerprint becomes the vector of its segments' bit counts. The Manhattan distance of two vectors is a lower bound of the fingerprints' Hamming distance, so fingerprints within RADIUS have vectors within RADIUS. The vectors lie in a grid whose axes are split into two halves: of two vectors within 3, one half differs by at most 1. A fingerprint stands in its own cell of each half and, as a visitor, in the cells that lie one step up on one axis; that meets every pair at distance 0 or 1 once at least. Pairs that meet are filtered by the Manhattan distance of the whole vectors, then verified by the exact bit distance.

Only distinct fingerprints enter the grid, so exact copies cost nothing there. Each crowded cell is searched by growing linked groups from a seed against what is still unlinked, which gives at most one link per fingerprint and cell (a spanning forest); the pairs of a group of near copies are never listed. Crowded means over CROWDED rows; smaller cells give their verified pairs. Groups follow from connected components.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer words than the shingle make one shingle of all; a null doc_id takes part but is never the least id (a group of null ids alone has a null one); repeated rows come out as often as they came in; an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import ASCII_LOWER, arrow_map, column, fields, materialize, read
from lattica.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Shingle of the pipeline stage: five words at a similarity of 0.8 or more.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Bits of a segment; 32 segments, 16 in each half. 1 gives the most selective grid, for over 10**9 distinct texts.
SEGMENT_BITS = 2
CROWDED = 48


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").translate(ASCII_LOWER).split()  # splits at \x20 and \x09-\x0D exactly
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total = np.zeros(64, np.int64)
    for at in range(0, len(words) - shingle + 1, 1 << 16):  # bounded memory for very long texts
        some = words[at : at + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(some[k : len(some) - shingle + 1 + k] for k in range(shingle)), strict=True))
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(some) - shingle + 1)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(words) - shingle + 1
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """keep's columns and fp (long, the fingerprint's bits)."""
    keep = ["doc_id"] if keep is None else keep
    light = docs.select(*[column(docs, c).alias(f"k{i}") for i, c in enumerate(keep)], column(docs, "text").cast("binary").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(len(keep))), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps)], [*keep, "fp"])

    return arrow_map(light, work, fields({c: light.schema[i].dataType for i, c in enumerate(keep)}, "fp long"))


def embed(fp: np.ndarray, segment_bits: int) -> np.ndarray:
    """(n, 64 / segment_bits) counts of set bits by segment."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fp), -1, segment_bits).sum(axis=2, dtype=np.uint8)


def cells(fp: np.ndarray, segment_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Cell key, index of the fingerprint, whether it is the fingerprint's own cell."""
    counts = embed(fp, segment_bits).astype(np.int64)
    half = counts.shape[1] // 2
    scale = (segment_bits + 1) ** np.arange(half, dtype=np.int64)
    for side in range(2):
        own = counts[:, side * half : (side + 1) * half]
        key = own @ scale * 2 + side
        yield key, np.arange(len(fp)), True
        for axis in range(half):
            up = np.flatnonzero(own[:, axis] < segment_bits)
            yield key[up] + 2 * scale[axis], up, False


def verified(a: np.ndarray, b: np.ndarray, segment_bits: int, radius: int) -> np.ndarray:
    """The Manhattan bound first, the exact distance for what passes."""
    near = np.abs(embed(a, segment_bits).astype(np.int16) - embed(b, segment_bits)).sum(axis=1) <= radius
    at = np.flatnonzero(near)
    return at[np.bitwise_count(a[at] ^ b[at]) <= radius]


def crowd(fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that is linked within a cell, at most one per fingerprint: each linked group is grown from a seed. Rows are distinct by (fp, home); a pair of visitors needs no link here."""
    rest, a, b = np.arange(len(fp)), [], []
    grow: list[int] = []
    while len(rest):
        if not grow:
            homes = np.flatnonzero(home[rest])
            if not len(homes):
                break
            grow, rest = [rest[homes[0]]], np.delete(rest, homes[0])
        at = grow.pop()
        near = np.bitwise_count(fp[rest] ^ fp[at]) <= radius
        if not home[at]:
            near &= home[rest]
        found = rest[near]
        if len(found):
            a.append(np.full(len(found), fp[at]))
            b.append(fp[found])
            grow.extend(found.tolist())
            rest = rest[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def cell_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, segment_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells of rows sorted by key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    homes = np.add.reduceat(home.astype(np.int64), starts)
    out_a, out_b = [], []
    small = (sizes > 1) & (sizes <= CROWDED) & (homes > 0)
    # Each home row of a small cell meets every row of its cell; of two home rows, the later one is skipped.
    at = np.flatnonzero(np.repeat(small, sizes) & home)
    if len(at):
        cell = np.repeat(np.arange(len(starts)), sizes)[at]
        for lo in range(0, len(at), 1 << 15):
            rows, c = at[lo : lo + (1 << 15)], cell[lo : lo + (1 << 15)]
            n = sizes[c]
            left = np.repeat(rows, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[c], n)
            fit = (fp[left] != fp[right]) & (~home[right] | (right > left))
            left, right = left[fit], right[fit]
            ok = verified(fp[left], fp[right], segment_bits, radius)
            out_a.append(fp[left[ok]])
            out_b.append(fp[right[ok]])
    for c in np.flatnonzero((sizes > CROWDED) & (homes > 0)):
        a, b = crowd(fp[starts[c] : starts[c] + sizes[c]], home[starts[c] : starts[c] + sizes[c]], radius)
        out_a.append(a)
        out_b.append(b)
    none = np.empty(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def links(fps: DataFrame, radius: int = RADIUS, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """fps (fp: long, distinct) -> a, b: links whose components are those of all pairs within radius (3 at most)."""
    if radius > 3:
        raise ValueError("the two halves of the grid serve a radius of 3 at most")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for key, at, own in cells(fp, segment_bits):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at].view(np.int64)), pa.array(np.full(len(at), own))], ["key", "fp", "home"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b = cell_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), segment_bits, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            key, fp, home = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            cut = int(np.searchsorted(key, key[-1]))  # the last cell may go on in the next batch
            if cut:
                held.append((key[:cut], fp[:cut], home[:cut]))
                yield done(held)
                held = []
            held.append((key[cut:], fp[cut:], home[cut:]))
        if held:
            yield done(held)

    spread_out = arrow_map(fps.select("fp"), spread, "key long, fp long, home boolean")
    dealt = spread_out.repartition("key").sortWithinPartitions("key")
    return arrow_map(dealt, search, "a long, b long").distinct()


def grouped(prints: DataFrame, radius: int = RADIUS, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """prints (doc_id, fp, materialized) -> fp, component_id: a row per distinct fingerprint."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes, radius, segment_bits))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    return prints.join(grouped(prints, radius, segment_bits), "fp").select("doc_id", "fp", "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
