import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import near_copies, simhash
from lattica.llm.components import components


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


def plain_fingerprint(text):
    words = text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_query(spark, sf, texts):
    rows = {r.doc_id: r for r in simhash.op3(spark, sf).collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    assert [rows[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    roots = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert [rows[i].component_id for i in ids] == [ids[r] for r in roots]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.sampled_from([1, 2, 4]), st.sampled_from([2, 6, 200]))
def test_grid_loses_no_link(spark, seed, spread, bits, crowded):
    """Clusters around a few centres, so that cells are crowded and chains are long."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = sorted({int(centres[rng.integers(4)]) ^ sum(1 << int(b) for b in rng.integers(0, spread, rng.integers(0, 6))) for _ in range(150)})
    a = np.array(fps, np.uint64)
    keep, simhash.CROWDED = simhash.CROWDED, crowded
    try:
        pairs = []
        rows = [(k, a[i], h) for key, at, h in simhash.cells(a, bits) for k, i in zip(key.tolist(), at.tolist(), strict=True)]
        rows.sort(key=lambda x: x[0])
        x, y = simhash.cell_links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows]), bits, 3)
        place = {f: i for i, f in enumerate(fps)}
        pairs = [(place[int(p)], place[int(q)]) for p, q in zip(x, y, strict=True)]
    finally:
        simhash.CROWDED = keep
    assert all((fps[p] ^ fps[q]).bit_count() <= 3 for p, q in pairs)
    brute = [(p, q) for p in range(len(fps)) for q in range(p) if (fps[p] ^ fps[q]).bit_count() <= 3]
    assert union(len(fps), pairs) == union(len(fps), brute)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 0, 100: 90, 95: 90, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def jaccard(a, b):
    a, b = (set(near_copies.shingle_hashes(x.encode(), 5).tolist()) for x in (a, b))
    return len(a & b) / max(1, len(a | b))


def test_near_copies_by_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = rng.choice(words, 150).tolist()
        texts.append(" ".join(base))
        for cut in (1, 3, 10, 40):
            copy = list(base)
            for k in rng.integers(0, 150, cut):
                copy[k] = "new" + str(rng.integers(10**6))
            texts.append(" ".join(copy))
    texts += texts[:5] + [texts[0].upper()]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in near_copies.keep_one(df).collect()}
    low = [t.lower() for t in texts]
    roots = union(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(low[a], low[b]) >= 0.8])
    assert kept == set(roots)


def test_odd_rows(odd, none, clashing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.fp == 0} == {2}
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 6, 8, 9]
    assert near_copies.keep_one(none).count() == 0
    assert near_copies.keep_one(clashing).columns == clashing.columns
