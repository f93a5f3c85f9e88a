"""Groups of near copies for deduplication: SimHash links, and links by the Jaccard similarity of shingle sets.

The SimHash grid of `simhash` links texts whose fingerprints differ in few bits. At a Jaccard similarity of 0.8 two fingerprints differ in about ten bits of 64, which no grid over bit counts can search selectively, so those pairs come from MinHash bands: BANDS keys of ROWS minima each; a pair at the threshold of 0.8 shares a key with probability 0.9996. All that meets in a band is verified by the exact similarity of the shingle sets, growing linked groups from a seed, so that a crowded band gives at most one link per text and never lists its pairs.

Copies that agree in all shingles count once: only one representative of each class enters grid and bands, and shingle sets are made, in a second look at the texts, only for representatives that share a key with another.

Defined results: null and wordless texts are one class; fewer words than the shingle make one shingle; rows equal in id and text are copies of each other; the row that stays has the least doc_id of its group (nulls last), then the least content key; rows and shingle sets are known by 128-bit keys; an empty table gives no rows; other columns pass through, packed, under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import ASCII_LOWER, arrow_map, column, content_key, fields, materialize, packed
from lattica.llm.components import components
from lattica.llm.simhash import RADIUS, SEED, SEGMENT_BITS, STAGE_SHINGLE, STAGE_SIMILARITY, links

BANDS, ROWS = 20, 5
CHUNK = 1 << 14


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k : k + n] for k in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)


def simhash(h: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        total += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 62, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def band_keys(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 10):
        np.minimum(least, (h[at : at + (1 << 10)] * a + b).min(axis=1), out=least)
    return np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """For each row: doc_id, key (of its content), fp, set_id, bands."""
    light = docs.select(column(docs, "doc_id").alias("doc_id"), row_key(docs).alias("key"), column(docs, "text").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = seeds()
        for batch in batches:
            fp, ids, bands = [], [], []
            for t in batch.column(2):
                h = shingle_hashes(t.as_py(), shingle)
                fp.append(simhash(h))
                s = np.unique(h)
                ids.append(xxhash.xxh3_128_digest(s.tobytes(), SEED))
                bands.append(band_keys(s, a, b).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "key", "fp", "set_id", "bands"],
            )

    return arrow_map(light, work, fields({"doc_id": light.schema["doc_id"].dataType}, "key binary, fp long, set_id binary, bands array<long>"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (set_id, text: bytes) -> set_id, shingles (sorted distinct hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["set_id", "shingles"])

    return arrow_map(texts, work, "set_id binary, shingles array<long>")


def row_key(docs: DataFrame):
    return content_key(column(docs, "doc_id"), column(docs, "text"))


def set_links(ids: list[bytes], sets: list[np.ndarray], similarity: float) -> list[tuple[bytes, bytes]]:
    """At most one link per set, joining all that is linked by pairs of that similarity."""
    out, rest, grow = [], list(range(1, len(ids))), [0]
    while rest:
        at = grow.pop() if grow else rest.pop()
        if not rest:
            break
        own = sets[at]
        sizes = np.array([len(sets[i]) for i in rest])
        all_ = np.concatenate([sets[i] for i in rest])
        place = np.searchsorted(own, all_)
        met = len(own) and own[np.minimum(place, len(own) - 1)] == all_
        both = np.add.reduceat(np.r_[met if len(own) else np.zeros(len(all_), bool), False].astype(np.int64), np.cumsum(sizes) - sizes) * (sizes > 0)
        near = both >= similarity * (len(own) + sizes - both)
        out += [(ids[at], ids[i]) for i, x in zip(rest, near, strict=True) if x]
        grow += [i for i, x in zip(rest, near, strict=True) if x]
        rest = [i for i, x in zip(rest, near, strict=True) if not x]
    return out


def band_links(docs: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """reps (set_id, key: the row of docs that stands for it, bands), distinct by set_id -> a, b.

    Near copies share most of their bands, so many bands have the same members; of those, told by number and two hashes of the members, one is searched and shipped."""
    keys = reps.select("set_id", F.explode("bands").alias("band"))
    each = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("set_id"))).alias("y"))
    shared = each.where("n > 1").groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")
    members = materialize(keys.join(shared, "band"), "bands")
    wanted = materialize(reps.select("set_id", "key").join(members.select("set_id").distinct(), "set_id"), "wanted")
    texts = docs.select(row_key(docs).alias("key"), column(docs, "text").cast("binary").alias("text")).join(wanted, "key").select("set_id", "text")
    sets = materialize(shingle_sets(texts, shingle), "sets").where(F.size("shingles") > 0).dropDuplicates(["set_id"])
    rows = members.join(sets, "set_id").select("band", "set_id", "shingles")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            got = set_links(ids, sets, similarity) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.binary()) for k in (0, 1)], ["a", "b"])

        band, ids, sets = None, [], []
        for b in batches:
            for key, i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if key != band:
                    if len(ids) > 1:
                        yield done(ids, sets)
                    band, ids, sets = key, [], []
                ids.append(i)
                sets.append(np.sort(s.values.to_numpy()))
        if len(ids) > 1:
            yield done(ids, sets)

    return arrow_map(rows.repartition("band").sortWithinPartitions("band"), search, "a binary, b binary").distinct()


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, radius: int = RADIUS, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """docs with one row of each group of near copies. Columns as before."""
    rows = materialize(sketches(docs, shingle), "sketches")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    reps = materialize(rows.groupBy("set_id", "fp").agg(F.min_by(F.struct("doc_id", "key"), order).alias("least"), F.first("bands").alias("bands")), "classes")
    # Nodes are sets. What shares a set or a fingerprint, or is linked by fingerprint or by set, is one group.
    first = reps.groupBy("fp").agg(F.min("set_id").alias("first"))
    same = reps.join(first, "fp").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    by_bits = links(reps.select("fp").distinct(), radius, segment_bits)
    by_bits = by_bits.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    sets = reps.groupBy("set_id").agg(F.min("least.key").alias("key"), F.first("bands").alias("bands"))
    all_links = same.union(by_bits).union(band_links(docs, sets, shingle, similarity)).where("a != b")
    roots = components(all_links)
    groups = reps.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    stay = groups.groupBy("root").agg(F.min_by("least", F.struct(F.col("least.doc_id").isNull(), F.col("least.doc_id"), F.col("least.key"))).alias("least")).select(F.col("least.key").alias("key"))
    whole = packed(docs).withColumn("key", content_key(F.col("row.doc_id"), F.col("row.text")))
    return whole.join(materialize(stay, "stay"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
