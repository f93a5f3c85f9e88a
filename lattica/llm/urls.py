"""URL filters: rules by host and path, and for what no rule fits a ratio of two character language models.

Two variable-order Markov models over the bytes of a URL, one of accepted and one of rejected URLs, give each byte a probability that interpolates the orders 0 to ORDER by Witten-Bell: an order's maximum-likelihood estimate weighs as its context's count against the number of different bytes seen there. Contexts are known exactly, by number. The score is (log p_accepted - log p_rejected) / number of bytes, and the verdict is allow at or above a threshold that held-out labelled URLs fix.

Labels are the rules themselves: URLs that an allow rule fits are accepted, those that a block rule fits rejected. The models are fitted on up to TRAIN_ROWS of either, the distinct URLs of least hash; every HOLD_OUT-th of them, by hash, only calibrates.

Rules: host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; path goes on up to `?`, `#` or the end. A rule `host/path` fits its host and all subdomains if the URL's path starts with the rule's; the longest rule wins.

Defined results: a null URL, or one without `://`, has empty host and path and no rule; an empty or null URL scores 0; without labels of both kinds every score and the threshold are 0, so all that no rule blocks is allowed; repeated rows are judged each by itself; an empty table gives no rows; other columns are not touched.

Plan: only the URL column is read; the driver holds 2 x TRAIN_ROWS URLs and the tables, both bounded; nothing but the sample is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import LOWER, UPPER, arrow_map, column, read

#: Verdict and rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER, TRAIN_ROWS, HOLD_OUT = 5, 20_000, 5
#: Bytes that are scored at once.
CHUNK = 1 << 18


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as verdict and rule; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def strings(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of each byte as a number, the byte lowest and the farthest context byte highest, and the start of each URL. A URL begins in a context of zeros and ends with a zero."""
    pad = b"\0" * order
    raw = np.frombuffer(b"".join(pad + u + b"\0" for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 for u in urls])
    at = np.arange(sizes.sum()) + np.repeat((np.arange(len(urls)) + 1) * order, sizes)
    out = raw[at]
    for d in range(1, order + 1):
        out |= raw[at - d] << (8 * d)
    return out, np.cumsum(sizes) - sizes


def chunks(urls: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of URLs of about CHUNK bytes."""
    some: list[bytes] = []
    size = 0
    for u in urls:
        some.append(u)
        size += len(u) + 1
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


class Markov:
    """For each order: contexts with their counts and how many different bytes follow them; (context, byte) strings with their counts. All sorted by number, so that a lookup is a binary search."""

    def __init__(self, urls: list[bytes], order: int = ORDER) -> None:
        self.order = order
        keys, counts = np.empty(0, np.int64), np.empty(0)
        for some in chunks(urls):
            k, n = np.unique(strings(some, order)[0], return_counts=True)
            keys, where = np.unique(np.concatenate((keys, k)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n)), len(keys))
        self.seen, self.contexts = [], []
        for d in range(order + 1):
            short, where = np.unique(keys & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            n = np.bincount(where, counts, len(short))
            ctx, of = np.unique(short >> 8, return_inverse=True)
            self.seen.append((short, n))
            self.contexts.append((ctx, np.bincount(of, n, len(ctx)), np.bincount(of, minlength=len(ctx)).astype(float)))

    def log(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), 1 / 256)
        for d, ((short, count), (ctx, total, kinds)) in enumerate(zip(self.seen, self.contexts, strict=True)):
            own = grams & ((1 << 8 * (d + 1)) - 1)
            at, c = place(short, own), place(ctx, own >> 8)
            n = np.where(c >= 0, total[c], 0)
            p = np.where(n > 0, (np.where(at >= 0, count[at], 0) + kinds[c] * p) / np.maximum(n + kinds[c], 1), p)
        return np.log(p)


def place(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands; -1 if it does not."""
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return np.where(sorted_[at] == keys, at, -1)


def scores(urls: list[bytes], good: Markov | None, bad: Markov | None) -> np.ndarray:
    if not urls or good is None or bad is None:
        return np.zeros(len(urls))
    out = []
    for some in chunks(urls):
        grams, starts = strings(some, good.order)
        each, where = np.unique(grams, return_inverse=True)
        total = np.add.reduceat((good.log(each) - bad.log(each))[where], starts)
        sizes = np.array([len(u) for u in some])
        out.append(np.where(sizes > 0, total / np.maximum(sizes, 1), 0.0))
    return np.concatenate(out)


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold of the best balanced accuracy on held-out scores; midway between the scores around it."""
    if not len(good) or not len(bad):
        return 0.0
    both = np.unique(np.concatenate((good, bad)))
    cuts = np.concatenate(([both[0] - 1e-9], (both[1:] + both[:-1]) / 2, [both[-1] + 1e-9]))
    kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    gone = np.searchsorted(np.sort(bad), cuts) / len(bad)
    best = np.flatnonzero(kept + gone == (kept + gone).max())
    return float(cuts[best[len(best) // 2]])


def fit(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, rows: int = TRAIN_ROWS) -> tuple[Markov | None, Markov | None, float]:
    """urls (url) -> models of accepted and rejected URLs, threshold."""
    hit = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    known = urls.where(F.col("url").isNotNull()).select("url", hit.alias("v")).where("v IS NOT NULL").distinct()
    sides = []
    for v in ("allow", "block"):
        got = [r.url.encode() for r in known.where(F.col("v") == v).orderBy(F.xxhash64("url"), "url").limit(rows).select("url").collect()]
        held = [u for i, u in enumerate(got) if i % HOLD_OUT == 0]
        learnt = [u for i, u in enumerate(got) if i % HOLD_OUT]
        sides.append((Markov(learnt) if learnt else None, held))
    (good, held_good), (bad, held_bad) = sides
    if good is None or bad is None:
        return None, None, 0.0
    return good, bad, calibrated(scores(held_good, good, bad), scores(held_bad, good, bad))


def filtered(pages: DataFrame, id_: str = "page_id", rules: tuple[tuple[str, str], ...] = RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """id, url, host, path, rule, score, verdict for every row of pages (url)."""
    light = pages.select(column(pages, id_).alias("id"), column(pages, "url").alias("url"))
    good, bad, least = fit(light.select("url"), rules, rows)
    model = pages.sparkSession.sparkContext.broadcast((good, bad))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [(u or "").encode() for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(urls, *model.value))], ["id", "url", "score"])

    judged = arrow_map(light, work, f"id {light.schema['id'].dataType.simpleString()}, url string, score double")
    judged = judged.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= least, "allow").otherwise("block"))
    return judged.select(F.col("id").alias(id_), "url", "host", "path", F.col("hit.rule").alias("rule"), "score", verdict.alias("verdict"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page."""
    return filtered(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
