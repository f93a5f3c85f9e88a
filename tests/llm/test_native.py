"""Decontamination and sharding: DataFrame operations alone."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lattica.llm import decontaminate, shard


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    w, hit, found = words(text), set(), set()
    for name, it in items:
        v = words(it)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return len(w), len(hit), len(found)


ITEMS = [("1", "One two three four five six seven eight nine ten eleven"), ("2", "short Été item"), ("3", None), ("4", "..."), ("5", "three four five six seven eight nine ten eleven twelve")]


@pytest.mark.parametrize("most", [decontaminate.MAX_SLOTS, decontaminate.PAGE, 8])
def test_windows(spark, odd, most):
    """Wide maps and one that lets nearly every window through."""
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = [(1, "x one TWO, three four five six seven eight nine ten eleven twelve y"), (2, "a short Été-item b"), (3, "a short été item"), (4, None), (5, ""), (6, "short Été item short Été item")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], odd.schema)
    from pyspark.sql import functions as F

    got = decontaminate.hits(df.select(F.struct("doc_id").alias("row"), F.col("text").alias("__text")), bench, max_slots=most).collect()
    assert {r.row.doc_id: (r.n_words, len(r.covered), len(r["items"])) for r in got} == {i: plain(t, ITEMS) for i, t in docs}
    assert {r.doc_id for r in decontaminate.decontaminate(df, bench, max_slots=most).collect()} == {3, 4, 5}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench, "spans", max_slots=most).collect()}
    assert spans == {1: "x y", 2: "a b", 3: "a short été item", 4: None, 5: "", 6: ""}


def test_long_hit_texts_take_linear_time(spark, odd):
    """192,000 words, all hit but the last."""
    bench = spark.createDataFrame([("1", "a b c")], "item_id string, text string")
    df = spark.createDataFrame([(1, "a b c " * 64_000 + "d", "en", "s", 0)], odd.schema)
    assert [r.text for r in decontaminate.decontaminate(df, bench, "spans").collect()] == ["d"]
    assert decontaminate.decontaminate(df, bench).count() == 0


def test_slot_map(spark):
    from pyspark.sql import functions as F

    some = spark.range(300).select((F.xxhash64("id")).alias("h"))
    for slots in (8, 1 << 15, 1 << 20):
        whole = decontaminate.slot_map(some, "h", slots)
        want = {r.h & (slots - 1) for r in some.collect()}
        assert len(whole) == slots and {i for i, x in enumerate(whole) if x} == want
        got = spark.range(40_000).select((F.col("id") - 20_000).alias("h")).where(decontaminate.is_set(whole, F.col("h"))).collect()
        assert {r.h for r in got} == {h for h in range(-20_000, 20_000) if h & (slots - 1) in want}


def test_query_against_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    want = c.execute(decontaminate.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = decontaminate.op10(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all() and want.contaminated.any()


def test_decontaminate_odd(spark, odd, none, clashing):
    bench = spark.createDataFrame([("9", "token abcdefghijkl"), (None, "null id text here")], "item_id string, text string")
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 9
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == 11
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(clashing, bench).columns == clashing.columns


def test_hypergeometric():
    rng = np.random.default_rng(1)
    for good, bad, draws in [(5, 7, 4), (1000, 3000, 500), (3, 0, 2), (0, 9, 5), (50, 50, 100)]:
        got = [shard.hypergeometric(good, bad, draws, u) for u in rng.random(3000)]
        want = rng.hypergeometric(good, bad, draws, 3000)
        assert abs(np.mean(got) - want.mean()) < 0.1 * max(1, want.std()) and abs(np.std(got) - want.std()) < 0.1 * max(1, want.std())
    big = shard.hypergeometric(3 * 10**10, 45 * 10**10, 10**8, 0.5)
    assert abs(big - 10**8 / 16) < 10**5
    m = shard.matrix([100, 7, 0, 33], 16, 3)
    assert [sum(r) for r in m] == [100, 7, 0, 33] and set(map(sum, zip(*m, strict=True))) <= {8, 9}


def test_shards(spark, sf, texts):
    rows = shard.op8(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in by.items() for i in range(n)}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 for r in rows)
    again = {r.doc_id: (r.shard, r.slot) for r in shard.op8(spark, sf).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_shuffle_is_uniform(spark):
    """Chi-square over shards of neighbouring ids, and slots that do not follow ids."""
    df = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    rows = sorted((r.doc_id, r.shard, r.slot) for r in shard.shard_documents(df, 4).collect())
    table = np.array([[sum(1 for i, s, _ in rows if i // 500 == b and s == k) for k in range(4)] for b in range(8)])
    assert ((table - 125) ** 2 / 125).sum() < 60
    assert abs(np.corrcoef([r[0] for r in rows], [r[2] for r in rows])[0, 1]) < 0.06


def test_shard_odd(odd, none, clashing):
    out = shard.shard_documents(odd, 3)
    assert out.columns == [*odd.columns, "shard", "slot"] and out.count() == 11
    assert {(r.shard, r.slot) for r in out.collect()} == {(s, i) for s, n in ((0, 4), (1, 4), (2, 3)) for i in range(n)}
    assert shard.shard_documents(none).count() == 0
    assert set(shard.shard_documents(clashing).columns) == set(clashing.columns)
