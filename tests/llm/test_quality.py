import math
import re
from collections import Counter

import xxhash

from lattica.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


WORD64 = (1 << 64) - 1


def finalised(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & WORD64
    return x ^ x >> 29


def plain_grams(text, buckets):
    """Buckets of byte trigrams, and after them those of word bigrams, one at a time."""
    raw = text.encode()
    for i in range(len(raw) - 2):
        yield finalised(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) % buckets
    words = [xxhash.xxh64_intdigest(w, 7) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    for a, b in zip(words, words[1:]):
        yield buckets + finalised((a * 0x9E3779B97F4A7C15 + b) & WORD64) % buckets


def plain_judge(texts, parts, buckets):
    """Score and threshold by dictionaries. texts: id -> text; parts: id -> target, trusted or rejected."""
    grams = {i: list(plain_grams(t, buckets)) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if parts.get(i) == "target":
            target.update(g)
    ratio = {}
    for kind in (range(buckets), range(buckets, 2 * buckets)):
        all_raw, all_target, prior = sum(raw[k] + 0.5 for k in kind), sum(target[k] for k in kind), 0.01 * buckets
        for k in kind:
            shape = (raw[k] + 0.5) / all_raw
            ratio[k] = math.log((target[k] + prior * shape) / (all_target + prior) / shape)
    score = {i: sum(ratio[k] for k in g) / len(g) if g else 0.0 for i, g in grams.items()}
    through = {i for i, t in texts.items() if (m := plain(t))[0] >= 50 and 2 * m[4] <= m[0]}
    good, bad = (sorted(score[i] for i in through if parts.get(i) == p) for p in ("trusted", "rejected"))
    low = good[math.floor(quality.KEEP_TRUSTED * (len(good) - 1))]
    below = [x for x in bad if x < low]
    return score, (low + max(below)) / 2 if below else low


def parts_of(labels):
    return {r.doc_id: r.part for r in quality.labelled(labels).collect()}


def test_query(spark, sf, texts):
    """Measures, base rule, score and verdict of every document by plain loops."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    said = {r.doc_id: r.quality for r in labels.collect()}
    parts = parts_of(labels)
    assert set(parts) == set(said) and all((said[i] == 0) == (p == "rejected") for i, p in parts.items())
    score, least = plain_judge({i: t or "" for i, t in texts.items()}, parts, quality.BUCKETS)
    rows = quality.op2(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        m = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert abs(r.score - score[r.doc_id]) < 1e-9 and r.kept == (not r.base_failed and score[r.doc_id] >= least - 1e-12)
    right = [r.kept == bool(said[r.doc_id]) for r in rows if parts.get(r.doc_id) in ("trusted", "rejected") and not r.base_failed]
    assert len(right) > 10 and sum(right) >= 0.95 * len(right)


def test_ratio_against_brute_force(spark):
    docs = [(i, " ".join(f"good{k * 7 % 31} words{k}" for k in range(i, i + 40))) for i in range(40)] + [(i, " ".join(f"### {i} $$${k} BUY!!" for k in range(20))) for i in range(40, 46)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(46)], "doc_id bigint, quality int")
    parts = parts_of(labels)
    assert 0 < sum(p == "trusted" for p in parts.values()) < 20
    want, least = plain_judge(dict(docs), parts, 256)
    got = {r.doc_id: r for r in quality.quality(df, labels, buckets=256).select("row.doc_id", "kept", "score").collect()}
    assert all(abs(got[i].score - x) < 1e-9 and got[i].kept == (x >= least) for i, x in want.items())
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(40, 46))


def test_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (6, None, 1), (7, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.quality(odd, labels).select("row.*", "n_words", "base_failed", "kept").collect()
    assert len(rows) == 11 and {r.n_words for r in rows if r.text is None} == {0} and all(r.base_failed for r in rows if r.n_words < 50)
    assert [r.base_failed for r in rows if r.doc_id == 6] == [True]
    assert quality.quality(none, labels).count() == 0
    out = quality.quality(clashing, labels.limit(0))
    assert out.select("row.*").columns == clashing.columns and out.where("kept OR base_failed").count() == 6
