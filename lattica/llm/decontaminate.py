"""Benchmark decontamination (native): a broadcast hash set of normalised test n-grams, a scan of training token windows, exact verification, removal of documents or spans.

Words are the runs of characters other than ASCII non-alphanumerics, A-Z lowered. A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of any window is hit.

Defined results: a null text has no words; a null item text has no windows; repeated rows are judged each by itself; empty tables give no rows or no hits; a null item_id counts as an item under the empty name; other columns of either table pass through untouched and may bear any name.

Plan: one scan of the documents, split into words once. The hash sets are maps of MAX_SLOTS slots at most, constants in the plan: the first holds the hash of each window's first two words, the second that of the whole window. They serve a benchmark of any size; a fuller map only lets more windows through. Windows that pass both leave the row with its key, meet the benchmark's windows by their text (the verification; Spark broadcasts that table only where its written size is small), and one small row per document is grouped. As a stage, hit rows are known by a 128-bit key of their content, written, and taken out of a second scan by an anti join: texts are not grouped, and not shuffled as long as Spark finds the keys small enough to broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import ascii_lower, content_key, materialize, packed, read

WINDOW = 10
#: Slots of a map, a byte each: 4 MB at most; below that, SLOTS_EACH for each window.
MAX_SLOTS, SLOTS_EACH = 1 << 22, 16
#: Slots of one row of a map under construction, as the bitmap functions have it.
PAGE = 1 << 15
#: Fixed: what stands between words, for Java's regular expressions.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed: a word and a gap in a text whose A-Z are not lowered.
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (string), n (words in the window), gram (its words, space-joined), head and hash; distinct."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    grams = items.select("item", size.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("g"))
    return grams.select("item", "n", F.array_join("g", " ").alias("gram"), F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1))).alias("head"), F.xxhash64("g").alias("hash")).distinct()


def slot_map(hashes: DataFrame, name: str, slots: int) -> bytes:
    """A byte for each slot: 1 at h mod `slots` (a power of two) for every long h of the column."""
    slot = F.col(name).bitwiseAND(slots - 1)
    pages = hashes.groupBy(F.shiftright(slot, 15).alias("page")).agg(F.bitmap_construct_agg(slot.bitwiseAND(PAGE - 1)).alias("bits"))
    whole = bytearray(max(slots, PAGE))
    for r in pages.collect():  # slots / PAGE rows
        whole[r.page * PAGE : (r.page + 1) * PAGE] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little").tobytes()
    return bytes(whole[:slots])


def is_set(whole: bytes, h: Column) -> Column:
    slot = h.bitwiseAND(len(whole) - 1).cast("int")
    return F.substring(F.lit(whole), slot + 1, F.lit(1)) == F.lit(b"\1")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_slots: int = MAX_SLOTS) -> DataFrame:
    """docs: row (any small thing), __text. One row per document: row, n_words, covered (sorted positions of hit words, 0-based), items (sorted distinct item names)."""
    grams = materialize(windows_of(benchmark, window), "windows")
    sizes = {r.n: r["count"] for r in grams.groupBy("n").count().collect()}  # `window` rows at most
    slots = min(max_slots, max(PAGE, 1 << (SLOTS_EACH * max(1, sum(sizes.values()))).bit_length()))
    heads, hashes = (slot_map(grams, c, slots) for c in ("head", "hash")) if sizes else (b"", b"")

    split = docs.withColumn("__id", F.monotonically_increasing_id()).withColumn("__w", words_of(F.col("__text"))).drop("__text")
    def found(n: int) -> Column:
        starts = F.when(F.size("__w") >= n, F.sequence(F.lit(0), F.size("__w") - n)).otherwise(F.array().cast("array<int>"))
        if n > 1:
            starts = F.filter(starts, lambda i: is_set(heads, F.xxhash64(F.get("__w", i), F.get("__w", i + 1))))
        starts = F.filter(starts, lambda i: is_set(hashes, F.xxhash64(F.slice("__w", i + 1, F.lit(n)))))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("__w", i + 1, F.lit(n)), " ").alias("gram")))

    none = F.array().cast("array<struct<at:int,n:int,gram:string>>")
    rows = split.select("__id", "row", F.size("__w").cast("long").alias("n_words"), F.explode_outer(F.concat(*map(found, sorted(sizes))) if sizes else none).alias("c"))
    items = grams.groupBy("n", "gram").agg(F.collect_set("item").alias("in_items"))
    items = materialize(items.select(F.col("n").alias("__n"), F.col("gram").alias("__gram"), "in_items"), "window-items")
    met = rows.join(items, (F.col("c.n") == F.col("__n")) & (F.col("c.gram") == F.col("__gram")), "left")
    hit = F.when(F.col("in_items").isNotNull(), F.sequence(F.col("c.at"), F.col("c.at") + F.col("c.n") - 1))
    return met.select("__id", "row", "n_words", hit.alias("at"), "in_items").groupBy("__id").agg(
        F.first("row").alias("row"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("covered"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("in_items")))).alias("items"),
    )


def without(pieces: Column, covered: Column) -> Column:
    """The pieces whose places are not covered (sorted), as runs between covered places."""
    before = F.concat(F.array(F.lit(-1)), covered)
    after = F.concat(covered, F.array(F.size(pieces)))
    gaps = F.filter(F.arrays_zip(before.alias("a"), after.alias("b")), lambda g: g["b"] > g["a"] + 1)
    return F.flatten(F.transform(gaps, lambda g: F.slice(pieces, g["a"] + 2, g["b"] - g["a"] - 1)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, max_slots: int = MAX_SLOTS) -> DataFrame:
    """docs without its contaminated documents (mode "documents"), or with the hit words and what follows each of them cut from the texts (mode "spans"). Columns as before."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    names, whole = docs.columns, packed(docs).withColumn("__key", content_key(F.col("row.doc_id"), F.col("row.text")))
    seen = hits(whole.select(F.col("__key").alias("row"), F.col("row.text").alias("__text")), benchmark, window, max_slots).where(F.size("covered") > 0)
    hit = seen.select(F.col("row").alias("__hit"), *(["covered"] if mode == "spans" else [])).dropDuplicates(["__hit"])
    hit = materialize(hit, "hit-rows")
    if mode == "documents":
        return whole.join(hit, F.col("__key") == F.col("__hit"), "left_anti").select("row.*")
    met = whole.join(hit, F.col("__key") == F.col("__hit"), "left")
    text = F.col("row.text")
    rest = without(F.regexp_extract_all(text, F.lit(WORD + GAP), F.lit(0)), F.col("covered"))
    cut = F.when(F.col("covered").isNull(), text).otherwise(F.concat(F.regexp_extract(text, "^" + GAP, 0), F.array_join(rest, "")))
    return met.select(*[cut.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    docs = read(spark, sf_dir, "documents").select(F.struct("doc_id").alias("row"), F.col("text").alias("__text"))
    seen = hits(docs, read(spark, sf_dir, "benchmark"))
    return seen.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("covered").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("covered") > 0).alias("contaminated"),
    )


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0
), starts AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized
), grams AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM starts
), sizes AS (SELECT DISTINCT n FROM grams
), places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes
), windows AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM places
), met AS (SELECT doc_id, i, n, item FROM windows JOIN grams USING (n, gram)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
