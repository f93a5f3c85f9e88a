"""Quality rules: the log-likelihood ratio of hashed n-grams between a trusted-target and a raw-corpus multinomial, length-normalised, with a deterministic threshold for every document.

Features are the bigrams of words and the trigrams of bytes (A-Z kept), each hashed into BUCKETS buckets of its own. The raw multinomial counts every document of the corpus; the target multinomial counts those of a bounded set of trusted documents: the up to TARGET_ROWS ids of quality 1 with the least keyed hash, but for every HOLD_OUT-th by another hash, which calibrate; as many ids of quality 0 calibrate too. A document's score is the sum of log(target / raw) over its n-grams divided by their number. The threshold is fixed before any document is judged: held-out trusted documents' scores put it at their KEEP_TRUSTED quantile, and rejected labelled ones, where they lie lower, move it halfway towards themselves; only documents that the base rule lets through calibrate.

Base rule: a text of fewer than MIN_WORDS words, or with more than half of its words in repeated windows of three words, fails.

Defined results: a null or empty text has no words (and fails the base rule); without labels of quality 1 every score is 0 and the base rule alone decides; an id that labels name twice is trusted if every label says so; repeated rows are judged each by itself; an empty table gives no rows; other columns pass through, packed, under any name.

Plan: a JVM scan copies the labelled documents' texts, TARGET_ROWS ids of either kind at most, into a small table; one Python scan of all documents counts (each task adds into fixed arrays and emits at most 2 x BUCKETS rows); the small table is scored; one Python scan scores all documents. Texts are never shuffled. The driver holds the BUCKETS-sized tables and the calibration scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, column, fields, materialize, packed, read

#: For each kind of n-gram.
BUCKETS = 1 << 15
TARGET_ROWS, HOLD_OUT = 20_000, 5
KEEP_TRUSTED = 0.002
MIN_WORDS = 50
#: Fixed: white space of the word rule, and the symbols that are counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Word hashes that a task remembers.
MEMO = 1 << 17
#: Words or bytes that are worked on at once.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """A stable 64-bit number for each word, the same in every process."""
    if len(memo) > MEMO:
        memo.clear()
    for w in {x for x in words if x not in memo}:
        memo[w] = xxhash.xxh64_intdigest(w, 7)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def features(text: bytes, words: list[bytes], memo: dict[bytes, int], buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams: byte trigrams below `buckets`, word bigrams from there on; in chunks."""
    raw = np.frombuffer(text, np.uint8)
    mask = np.uint64(buckets - 1)
    for at in range(0, len(raw) - 2, CHUNK):
        b = raw[at : at + CHUNK + 2].astype(np.uint64)
        yield (mix(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) & mask).astype(np.int64)
    for at in range(0, len(words) - 1, CHUNK):
        h = word_hashes(words[at : at + CHUNK + 1], memo)
        yield (mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & mask).astype(np.int64) + buckets


def labelled(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, part (target, trusted, rejected): `rows` ids of quality 1 and 0 each at most, by the least keyed hash; trusted and rejected ones calibrate."""
    each = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lambda q: each.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = F.pmod(F.xxhash64(F.lit(HOLD_OUT), F.col("doc_id")), F.lit(HOLD_OUT)) == 0
    good = pick(1).select("doc_id", F.when(held, "trusted").otherwise("target").alias("part"))
    return good.unionByName(pick(0).select("doc_id", F.lit("rejected").alias("part")))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TARGET_ROWS) -> tuple[np.ndarray, float]:
    """log(target / raw) by bucket, and the threshold."""
    parts = materialize(labelled(labels, rows), "labelled").select(F.col("doc_id").alias("__id"), "part")
    light = docs.select(column(docs, "doc_id").alias("id"), column(docs, "text").cast("binary").alias("text"))
    known = materialize(light.join(F.broadcast(parts), F.col("id") == F.col("__id")).select("part", "text"), "labelled-texts")  # 2 x `rows` ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        total = np.zeros(2 * buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                text = t.as_py() or b""
                for f in features(text, text.split(), memo, buckets):
                    total += np.bincount(f, minlength=2 * buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    def counted(texts: DataFrame) -> np.ndarray:
        table = arrow_map(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(2 * buckets)
        out[table.bucket.to_numpy(np.int64)] = table.n
        return out

    target = counted(known.where("part = 'target'"))
    if not target.any():
        return np.zeros(2 * buckets), -np.inf
    ratio = log_ratio(np.array([counted(light), target]))
    scores = scored(known.where("part != 'target'"), ratio, buckets).toPandas()
    return ratio, threshold(scores[scores.trusted].score.to_numpy(), scores[~scores.trusted].score.to_numpy())


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """counts: raw and target by bucket, the halves being kinds of n-grams. Each kind's target is smoothed by one raw-shaped pseudo-count a bucket, so that a bucket which the target never saw scores low but finitely."""
    raw, target = (x.reshape(2, -1) for x in counts)
    shape = (raw + 0.5) / (raw + 0.5).sum(axis=1, keepdims=True)
    prior = 0.01 * raw.shape[1]
    return np.log((target + prior * shape) / (target.sum(axis=1, keepdims=True) + prior) / shape).reshape(-1)


def threshold(trusted: np.ndarray, rejected: np.ndarray) -> float:
    if not len(trusted):
        return -np.inf
    low = float(np.quantile(trusted, KEEP_TRUSTED, method="lower"))
    below = rejected[rejected < low]
    return low if not len(below) else (low + float(below.max())) / 2


def score(text: bytes, words: list[bytes], memo: dict[bytes, int], ratio: np.ndarray, buckets: int) -> float:
    total, n = 0.0, 0
    for f in features(text, words, memo, buckets):
        total += float(ratio[f].sum())
        n += len(f)
    return total / n if n else 0.0


def scored(known: DataFrame, ratio: np.ndarray, buckets: int) -> DataFrame:
    """known (part, text) -> trusted, score of texts that the base rule lets through; the threshold need not part the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for b in batches:
            got = []
            for part, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or b""
                words = text.split()
                if not base_fails(len(words), repeated_words(words)):
                    got.append((part == "trusted", score(text, words, memo, ratio, buckets)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.bool_()), pa.array([x[1] for x in got], pa.float64())], ["trusted", "score"])

    return arrow_map(known, work, "trusted boolean, score double")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    _, pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)  # exact at any vocabulary
    _, where, times = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[where] > 1)
    edge = np.bincount(at, minlength=n + 3)[: n + 3] - np.bincount(at + 3, minlength=n + 3)[: n + 3]
    return int(np.count_nonzero(np.cumsum(edge)))


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def measures(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judged(rows: DataFrame, ratio: np.ndarray, least: float, buckets: int = BUCKETS) -> DataFrame:
    """rows (row: any, text: string) -> row and COLUMNS."""
    model = rows.sparkSession.sparkContext.broadcast(ratio)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py() or ""
                raw = text.encode()
                words = raw.split()
                m = measures(text, raw, words)
                failed = base_fails(m[0], m[4])
                s = score(raw, words, memo, model.value, buckets)
                out.append((*m, failed, s, not failed and s >= least))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], ["row", *(c.split()[0] for c in COLUMNS.split(", "))])

    return arrow_map(rows, work, fields({"row": rows.schema["row"].dataType}, COLUMNS))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TARGET_ROWS) -> DataFrame:
    """row (the whole document row as a struct) and COLUMNS."""
    ratio, least = fit(docs, labels, buckets, rows)
    return judged(packed(docs).select("row", F.col("row.text").alias("text")), ratio, least, buckets)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ratio, least = fit(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").alias("row"), "text")
    return judged(rows, ratio, least).withColumnRenamed("row", "doc_id")
