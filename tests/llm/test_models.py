"""URL models, token counts, mixing, context trees, languages."""

import math
import re
import time
from collections import Counter
from fractions import Fraction
from urllib.parse import urlsplit

import numpy as np
import pytest
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from lattica.llm import ctw, language, mix, tokens, urls


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


ODD_URLS = [None, "", "no scheme", "http://COM/en/x", "https://a.example.com/en/77?x", "http://example.net/de/81#f", "a://b://c.net/de/1", "http://xcom/en/", "http://com?/en/", "http://www.é.org/es/\n", "ftp://com/enx"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS)], "page_id bigint, url string")
    for r in urls.filtered(df).collect():
        host, path, best = plain_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        assert r.verdict == (best[0] if best else "allow" if r.score >= 0 else "block") or not best
    assert urls.filtered(df.limit(0)).count() == 0


def plain_markov(urls_, order):
    """Witten-Bell by dictionaries: log of the probability of each byte of a URL and its end."""
    seen = [{} for _ in range(order + 1)]
    for u in urls_:
        padded = b"\0" * order + u + b"\0"
        for i in range(order, len(padded)):
            for d in range(order + 1):
                seen[d].setdefault(padded[i - d : i], Counter())[padded[i]] += 1

    def log(u):
        padded, out = b"\0" * order + u + b"\0", 0.0
        for i in range(order, len(padded)):
            p = 1 / 256
            for d in range(order + 1):
                if c := seen[d].get(padded[i - d : i]):
                    p = (c[padded[i]] + len(c) * p) / (sum(c.values()) + len(c))
            out += math.log(p)
        return out

    return log


def test_scores_against_brute_force():
    """URL by URL, long ones and repeated ones too."""
    rng = np.random.default_rng(5)
    make = lambda letters, n: ["".join(rng.choice(list(letters), 6)).encode() for _ in range(n)]
    some, others = [b"http://" + x for x in make("ab/", 40)], [b"http://" + x for x in make("ac.", 40)]
    good, bad = plain_markov(some, urls.ORDER), plain_markov(others, urls.ORDER)
    asked = some[:5] + others[:5] + [b"http://zz", "http://é".encode(), b"http://" + b"ab/" * 100_000, some[0]]
    got = urls.scores(asked, urls.Markov(some), urls.Markov(others))
    assert np.allclose(got, [(good(u) - bad(u)) / len(u) for u in asked], atol=1e-6)


def test_filter_against_brute_force(spark):
    """Verdicts of URLs that no rule fits, with models and threshold fitted by dictionaries."""
    rng = np.random.default_rng(9)
    make = lambda host, n: [f"http://{''.join(rng.choice(list('ab'), 4))}.{host}/{rng.integers(9)}" for _ in range(n)]
    known = sorted({*make("net/de", 60), *make("com/en", 60)})
    free = [f"http://x.{h}/{k}" for h in ("net/dx", "com/ex") for k in range(6)]
    df = spark.createDataFrame(list(enumerate(known + free + known[:3])), "page_id int, url string")
    got = {r.url: r for r in urls.filtered(df).collect()}
    sides = []
    for v in ("allow", "block"):
        mine = [r.url.encode() for r in spark.createDataFrame([(u,) for u in known if plain_rule(u)[2][0] == v], "url string").orderBy(F.xxhash64("url"), "url").collect()]
        sides.append((plain_markov([u for i, u in enumerate(mine) if i % urls.HOLD_OUT], urls.ORDER), [u for i, u in enumerate(mine) if i % urls.HOLD_OUT == 0]))
    score = lambda u: (sides[0][0](u) - sides[1][0](u)) / len(u)
    held = [sorted(map(score, s[1])) for s in sides]
    best, least = None, None
    both = sorted({*held[0], *held[1]})
    cuts = [both[0] - 1e-9, *((a + b) / 2 for a, b in zip(both, both[1:])), both[-1] + 1e-9]
    worth = [sum(x >= c for x in held[0]) / len(held[0]) + sum(x < c for x in held[1]) / len(held[1]) for c in cuts]
    best = [c for c, w in zip(cuts, worth) if w == max(worth)]
    least = best[len(best) // 2]
    for u in free:
        assert abs(got[u].score - score(u.encode())) < 1e-5 and got[u].verdict == ("allow" if score(u.encode()) >= least else "block")


def test_markov_learns_and_calibrates(spark):
    rng = np.random.default_rng(2)
    make = lambda host, n: [f"http://{''.join(rng.choice(list('abcde'), 5))}.{host}/{rng.integers(999)}" for _ in range(n)]
    good, bad = urls.Markov([u.encode() for u in make("net/de", 300)]), urls.Markov([u.encode() for u in make("com/en", 300)])
    a, b = (urls.scores([u.encode() for u in make(h, 100)], good, bad) for h in ("net/de", "com/en"))
    cut = urls.calibrated(a, b)
    assert (a >= cut).mean() > 0.95 and (b < cut).mean() > 0.95
    grams, _ = urls.strings([b"ab"], urls.ORDER)
    assert good.log(grams).shape == (3,) and np.isfinite(good.log(grams)).all()


def test_urls_query(spark, sf):
    rows = urls.op4(spark, sf).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path, best = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None) and r.host == urlsplit(pages[r.page_id]).netloc.lower()
        assert best is None or r.verdict == best[0]


def test_token_histogram(spark, sf, texts, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sizes = sorted(len(e.ids) for e in t.encode_batch(list(texts.values()), add_special_tokens=False))
    found = tokens.op5(spark, sf)
    rows = {r.length: r for r in found.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(sizes)
    for k, r in rows.items():
        assert r.docs_at_least == sum(x >= k for x in sizes) and r.tokens_at_least == sum(x for x in sizes if x >= k) and r.truncated_tokens == sum(min(x, k) for x in sizes)
        assert abs(r.fits - sum(x <= k for x in sizes) / len(sizes)) < 1e-12
    for r in tokens.at_limits(found, [1, 100, 10**6]).collect():
        assert r.truncated_tokens == sum(min(x, r.context) for x in sizes) and r.docs_at_least == sum(x >= r.context for x in sizes)
    for r in tokens.quantiles(found, [0.1, 0.5, 1.0]).collect():
        assert r.length == sizes[math.ceil(r.share * len(sizes)) - 1]
    path, pattern = public_tokenizers.path(tokens.VOCABULARY), public_tokenizers.PATTERN
    assert {r.length: r.n_docs for r in tokens.histogram(odd, path, pattern).collect()}[0] == 3
    assert tokens.histogram(none, path, pattern).count() == 0


def plain_schedule(weights, blocks):
    """Slot of each (source, block) by trying every block at every slot."""
    total = sum(map(Fraction, weights.values()))
    w = {s: Fraction(x) / total for s, x in weights.items()}
    left = {(s, i) for s, n in blocks.items() if s in w for i in range(n)}
    out, slot = {}, 0
    while left:
        released = [(math.ceil((i + 1) / w[s]), s, i) for s, i in left if math.floor(i / w[s]) <= slot]
        if released:
            due, s, i = min(released)
            out[s, i] = slot
            left.remove((s, i))
        slot += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 5, "b": 3, "c": 0.01}, {"a": 0.9, "b": 0.05, "c": 0.05}, {"x": 1}, {s: n**0.7 for s, n in {"a": 10_000_000, "b": 1_200_000, "c": 78_000, "d": 901}.items()}])
def test_pfair_deviation(weights):
    """Less than one block from the target weights themselves, at every slot."""
    n = 20_000
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    had = Counter()
    for slot, (s, _, release, due, at) in enumerate(mix.timetable(mix.wholes(weights), {s: math.ceil(n * w) + 1 for s, w in share.items()})):
        if slot == n:
            break
        had[s] += 1
        assert at == slot and release <= at < due
        assert all(abs(had[x] - (slot + 1) * w) < 1 for x, w in share.items())


def test_mixing(spark, odd, none, clashing):
    df = spark.createDataFrame([(i, f"t{i}", "en", "a" if i % 3 else None, 0) for i in range(900)], odd.schema)
    light = df.select("doc_id", mix.source_key().alias("s"), mix.order_hash(df).alias("h"))
    rows = mix.scheduled(light, {"=a": 1, "null": 1}, block_rows=10).collect()
    assert len(rows) == 900 and all(r.release <= r.slot < r.deadline for r in rows)
    assert {(r.s, r.block): r.slot for r in rows} == plain_schedule({"=a": 1, "null": 1}, {"=a": 60, "null": 30})
    kept = mix.mixed(df, {"=a": 1, "null": 1}, block_rows=10, tolerance=0).collect()
    assert sum(r.source is None for r in kept) == 300 and abs(sum(r.source == "a" for r in kept) - 300) <= 10
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if r.in_mix) and mix.mixed(df, tolerance=None).count() == 900
    out = mix.mixed(odd)
    assert out.columns == odd.columns and mix.mixed(none).count() == 0 and mix.mixed(clashing).columns == clashing.columns
    assert mix.in_order(none).count() == 0 and mix.in_order(clashing).columns == clashing.columns and mix.in_order(odd).count() == 11
    assert mix.scheduled(light, {"=zzz": 1}).where("in_mix").count() == 0


def test_mixing_takes_any_number_of_sources(spark, odd):
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("host"), F.col("id") % 11_000).alias("source"), F.lit(1).alias("n_chars"))
    rows = mix.scheduled(df.select("doc_id", mix.source_key().alias("s"), mix.order_hash(df).alias("h"))).collect()
    assert len(rows) == 12_000 and all(r.release <= r.slot < r.deadline for r in rows) and len({r.slot for r in rows}) == 11_000


def test_mixing_query(spark, sf, documents):
    """op6 against a schedule made by trying every block."""
    rows = mix.op6(spark, sf).collect()
    sizes = Counter(r.source for r in rows)
    assert sizes == Counter(r.source for r in documents.select("source").collect())
    by_name = {s: n**mix.EXPONENT for s, n in sizes.items()}
    want = plain_schedule({f"={s}": w for s, w in by_name.items()}, {f"={s}": -(-n // mix.BLOCK_ROWS) for s, n in sizes.items()})
    assert all(r.slot == want[f"={r.source}", r.block] and r.block == r.rank // mix.BLOCK_ROWS for r in rows)
    assert {s: sorted(r.rank for r in rows if r.source == s) for s in sizes} == {s: list(range(n)) for s, n in sizes.items()}


def kt(bits):
    a = b = 0
    p = 0.0
    for x in bits:
        p += math.log(((b if x else a) + 0.5) / (a + b + 1))
        a, b = a + (not x), b + bool(x)
    return p


def test_context_tree_against_recursion():
    """Weighted probabilities by the textbook recursion over one bit's tree, sequentially counted."""
    text = b"abababbaab" * 3
    depth = 2
    grams = ctw.strings([text], depth)
    keys, counts = np.unique(grams, return_counts=True)
    got = dict(zip(keys.tolist(), ctw.string_logs(keys, counts.astype(float), depth), strict=True))

    def bits_after(ctx, prefix):
        padded = b"\0" * depth + text + b"\0"
        out = []
        for i in range(depth, len(padded)):
            if padded[i - len(ctx) : i] == ctx:
                s = f"{padded[i]:08b}"
                if s.startswith(prefix):
                    out.append(int(s[len(prefix)]))
        return out

    def weighted(ctx, prefix):
        own = kt(bits_after(ctx, prefix))
        if len(ctx) == depth:
            return own
        below = sum(weighted(bytes([c]) + ctx, prefix) for c in range(256) if bits_after(bytes([c]) + ctx, prefix)) if bits_after(ctx, prefix) else 0.0
        return np.logaddexp(own, below) + math.log(0.5)

    def predict(ctx, full, prefix, bit):
        seen = bits_after(ctx, prefix)
        p = ((sum(seen) if bit else len(seen) - sum(seen)) + 0.5) / (len(seen) + 1)
        if len(ctx) == depth or not bits_after(full[-len(ctx) - 1 :], prefix):
            return p
        stop = math.exp(math.log(0.5) + kt(seen) - weighted(ctx, prefix))
        return stop * p + (1 - stop) * predict(full[-len(ctx) - 1 :], full, prefix, bit)

    for key in keys.tolist()[:4]:
        full, sym = bytes([key >> 16 & 255, key >> 8 & 255]), f"{key & 255:08b}"
        want = sum(math.log(predict(b"", full, sym[:k], int(sym[k]))) for k in range(8))
        assert abs(got[key] - want) < 1e-6


def test_context_tree_sums_to_one():
    texts = [b"hello world", b"held"]
    keys, counts = np.unique(ctw.strings(texts, 3), return_counts=True)
    ctx = int(keys[5]) & ~255
    every = np.array(sorted(set(keys.tolist()) | {ctx | b for b in range(256)}))
    n = np.zeros(len(every))
    n[np.searchsorted(every, keys)] = counts
    logs = ctw.string_logs(every, n, 3)
    assert abs(np.exp(logs[(every & ~255) == ctx]).sum() - 1) < 1e-9


def test_lm_query(spark, sf, texts):
    rows = {r.doc_id: r for r in ctw.op7(spark, sf).collect()}
    low = {i: t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter()
    for i, t in low.items():
        if not held[i]:
            c.update([*t.split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in low.items():
        toks = [*t.split(), None]
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(toks), sum(c[x] > 0 for x in toks), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks)) < 1e-6 * len(toks)
        assert r.score < 0
    out = [r.bits_per_byte for r in rows.values() if r.held_out and r.n_bytes > 200]
    assert np.mean(out) < 3


def plain_tree(texts, depth):
    """Context-tree weighting by dictionaries: log10 probability of a text under the tree of `texts`."""
    low = lambda t: t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) + b"\0"

    def grams(t):
        padded = b"\0" * depth + low(t)
        return Counter((padded[i - depth : i], padded[i]) for i in range(depth, len(padded)))

    seen = Counter()
    for t in texts:
        seen.update(grams(t))
    count = {}
    for (ctx, byte), n in seen.items():
        for d in range(depth + 1):
            for k in range(8):
                count.setdefault((ctx[depth - d :], k, byte >> (8 - k)), [0, 0])[byte >> (7 - k) & 1] += n
    weighted, below = {}, Counter()
    half = math.log(0.5)
    stop = {}
    for node in sorted(count, key=lambda x: -len(x[0])):
        z, o = count[node]
        own = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
        if len(node[0]) == depth:
            weighted[node], stop[node] = own, 1.0
        else:
            weighted[node] = half + np.logaddexp(own, below[node])
            stop[node] = math.exp(half + own - weighted[node])
        if node[0]:
            below[node[0][1:], node[1], node[2]] += weighted[node]

    known = {}

    def log(ctx, byte):
        if (ctx, byte) not in known:
            total = 0.0
            for k in range(8):
                p, left = 0.0, 1.0
                for d in range(depth + 1):
                    node = (ctx[depth - d :], k, byte >> (8 - k))
                    z, o = count.get(node, (0, 0))
                    deeper = d < depth and (ctx[depth - d - 1 :], k, byte >> (8 - k)) in count
                    s = stop[node] if deeper else 1.0
                    p += left * s * ((o if byte >> (7 - k) & 1 else z) + 0.5) / (z + o + 1)
                    left *= 1 - s
                total += math.log10(p)
            known[ctx, byte] = total
        return known[ctx, byte]

    return lambda t: sum(n * log(*g) for g, n in grams(t).items())


def test_lm_scores_against_brute_force(spark, sf, texts):
    """The score of every document, held out or not."""
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    score = plain_tree([t for i, t in texts.items() if i not in held], ctw.DEPTH)
    for r in ctw.op7(spark, sf).select("doc_id", "score").collect():
        assert abs(r.score - score(texts[r.doc_id])) < 1e-6 * (1 + len(texts[r.doc_id]))


def test_lm_learns_nothing_from_held_out_texts(documents):
    with_, without = (
        {r.doc_id: r.score for r in ctw.scored(d).where("NOT held_out").collect()} for d in (documents, documents.where("crc32(cast(doc_id AS string)) % 7 != 2"))
    )
    assert with_.keys() == without.keys() and all(abs(with_[i] - without[i]) < 1e-9 * (1 + abs(with_[i])) for i in with_)


def test_lm_pieces_cut_long_texts():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 1, 50, 333)]
    want = ctw.strings(texts, 3)
    of, grams = (np.concatenate(x) for x in zip(*ctw.pieces(texts, 3, 10), strict=True))
    assert (grams == want).all() and of.tolist() == [i for i, t in enumerate(texts) for _ in range(len(t) + 1)]
    keys, logs = np.unique(want)[::2], np.arange(len(np.unique(want)[::2])) / 7
    total, owner, missed, times = ctw.byte_scores(texts, keys, logs, 3)
    table = dict(zip(keys.tolist(), logs.tolist(), strict=True))
    for i in range(4):
        mine = Counter(grams[of == i].tolist())
        assert abs(total[i] - sum(n * table.get(g, 0) for g, n in mine.items())) < 1e-9
        assert sum(times[(owner == i)]) == sum(n for g, n in mine.items() if g not in table)
    assert (np.diff(owner) >= 0).all()


def test_words_are_those_of_the_rule():
    import pyarrow as pa

    odd = ["", " a\tB\x0b\x0cc\r\n ", "x\x1cy\x85z\u00a0w \u2003É", "  ", "one"]
    of, found = ctw.words(pa.array(odd))
    assert [(int(i), w) for i, w in zip(of, found.to_pylist(), strict=True)] == [(i, w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for i, t in enumerate(odd) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


def test_lm_odd(odd, none):
    small = ctw.scored(odd, heavy=3, most=50).collect()
    whole = {(r.doc_id, r.n_bytes): r for r in ctw.scored(odd).collect()}
    assert len(small) == 11
    for r in small:
        w = whole[r.doc_id, r.n_bytes]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens) and abs(r.base_score - w.base_score) < 1e-6
        assert r.n_tokens >= 1 and math.isfinite(r.score)
    assert ctw.scored(none).count() == 0


def test_context_tree_dealt_by_context():
    """Levels before LOW, joined from parts, give the logs of the tree as a whole."""
    texts = [b"hello world, hello words" * 5, "ein wörtchen".encode(), b""]
    keys, counts = np.unique(ctw.strings(texts, 4), return_counts=True)
    counts = counts * (keys % 5 > 0).astype(float)
    for low in (1, 2, 3):
        group = keys >> 8 & ((1 << (8 * low)) - 1)
        halves = [np.flatnonzero(group % 3 == i) for i in range(3)]
        sums = [[np.full(len(x[1]), x[0]), *x[1:]] for h in halves for x in ctw.parts_above(keys[h], counts[h], 4, low)]
        above = ctw.joined_above(*(np.concatenate(x) for x in zip(*sums, strict=True)), low)
        whole = ctw.string_logs(keys, counts, 4)
        for h in halves:
            assert np.allclose(ctw.string_logs(keys[h], counts[h], 4, above), whole[h], atol=1e-9)


def test_lm_depth_is_the_same_at_every_size(spark, documents, odd):
    """Scores do not hang on how many strings fit a broadcast."""
    for docs in (documents, odd):
        want = sorted((r.doc_id or -1, r.n_bytes, r.score) for r in ctw.scored(docs).collect())
        for most in (0, 500):
            got = sorted((r.doc_id or -1, r.n_bytes, r.score) for r in ctw.scored(docs, most=most).collect())
            assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * (1 + abs(b[2])) for a, b in zip(got, want, strict=True))


def test_lm_slices_hold_every_row_once():
    import pyarrow as pa

    texts = ["", "abc", None, "x" * 25, "", "déf", "ghijkl", "m"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t, pa.string())], ["i", "text"]) for t in (texts, [], [""], texts[::-1])]
    got = list(ctw.slices(iter(batches), 1, 10))
    assert [t for b in got for t in b.column(1).to_pylist()] == [*texts, "", *texts[::-1]]
    assert all(b.num_rows and (b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 10) for b in got)


def test_lm_memory_of_a_task_does_not_grow_with_its_batches(spark, odd, monkeypatch):
    """What the tasks that read texts hold at most, on batches of 2 MB of text and of 24 MB; and the same results."""
    import tracemalloc

    import pyarrow as pa

    found, real = {}, ctw.arrow_map
    monkeypatch.setattr(ctw, "arrow_map", lambda df, work, schema: (found.__setitem__(schema, work), real(df, work, schema))[1])
    ctw.scored(odd).count()
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(300)])
    one = [" ".join(vocabulary[rng.integers(0, 300, 800)]) for _ in range(500)]
    for schema, work in found.items():
        if schema.startswith("id ") or schema == "key long, n long, m long":
            score = schema.startswith("id ")
            peaks, results = [], []
            for times in (1, 12):
                texts = one * times
                columns = [pa.array(np.arange(len(texts)) % 7 == 2), pa.array(texts)]
                batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), *columns] if score else columns, ["id", "held_out", "text"] if score else ["held_out", "text"])
                del texts, columns
                tracemalloc.start()
                out = [b.select(["id", "n_bytes", "score"] if score else ["key", "m"]) for b in work(iter([batch]))]
                peaks.append(tracemalloc.get_traced_memory()[1])
                tracemalloc.stop()
                results.append(sorted(r for b in out for r in zip(*b.to_pydict().values(), strict=True)))
            assert peaks[1] < 1.3 * peaks[0], (schema, peaks)
            if score:
                assert np.allclose([r[1:] for r in results[1]], [r[1:] for r in results[0]] * 12)
            else:
                assert [(k, 12 * m) for k, m in results[0]] == results[1]


def plain_language(rows, labels, strength=8.0, strength_said=2.0):
    """Posteriors by dictionaries. rows: (text, declared, suffix, domain, host); labels: (text, lang)."""
    langs = sorted({lang for _, lang in labels})

    def grams(text):
        raw = text.encode()
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 18 for i in range(len(raw) - 2)]

    counts = {lang: Counter() for lang in langs}
    for text, lang in labels:
        counts[lang].update(grams(text))
    size = {lang: sum(c.values()) + 0.5 * language.BUCKETS for lang, c in counts.items()}
    ll = [{lang: sum(math.log((counts[lang][g] + 0.5) / size[lang]) for g in grams(r[0])) / 3 for lang in langs} for r in rows]
    soft = lambda x: {k: math.exp(v - max(x.values())) / sum(math.exp(u - max(x.values())) for u in x.values()) for k, v in x.items()}
    q = [soft(x) for x in ll]

    def expected(some):
        return {lang: sum(q[i][lang] for i in some) for lang in langs}

    every = range(len(rows))
    top = {lang: (expected(every)[lang] + 1 / len(langs)) / (len(rows) + 1) for lang in langs}
    said = [i for i in every if rows[i][1]]
    out = []
    for i, (_, declared, suffix, domain, host) in enumerate(rows):
        prior = top
        for part in ((suffix,), (suffix, domain)):
            same = [j for j in every if rows[j][2 : 2 + len(part)] == part]
            prior = {lang: (expected(same)[lang] + strength * prior[lang]) / (len(same) + strength) for lang in langs}
        same = [j for j in every if rows[j][2:5] == (suffix, domain, host) and j != i]
        prior = {lang: (expected(same)[lang] + strength * prior[lang]) / (len(same) + strength) for lang in langs}
        lp = {lang: ll[i][lang] + math.log(prior[lang]) for lang in langs}
        if declared:
            like = [j for j in said if rows[j][1] == declared]
            for lang in langs:
                lp[lang] += math.log((expected(like)[lang] + strength_said * len(like) / len(said)) / (expected(said)[lang] + strength_said))
        out.append(soft(lp))
    return out


def test_language(spark, sf, odd, none):
    rows = language.op9(spark, sf).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    docs = [r for r in rows if r.doc_id is not None]
    assert len(docs) == len(langs) and sum(r.lang == langs[r.doc_id] for r in docs) >= 0.97 * len(docs)
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.de/x", "<html lang=de><script>the the</script><p>und der die"), (2, "http://a.de/x", ""), (None, "x", "<html lang='xx-YY'>")], "page_id bigint, url string, html string")
    out = language.fused(language.evidence_rows(odd, pages), odd.select("doc_id", "text", "lang")).collect()
    assert len(out) == 15 and all(0 < r.probability <= 1 for r in out)
    assert [r.declared for r in out if r.id.page_id == 2 and r.declared] == ["de"]
    assert all(r.lang is None for r in language.fused(language.evidence_rows(odd, pages), none.select("doc_id", "text", "lang")).collect())
    assert language.fused(language.evidence_rows(none, pages.limit(0)), none.select("doc_id", "text", "lang")).count() == 0


def test_language_held_out(spark, documents):
    """Documents that declare nothing and whose labels train nothing."""
    rows = [r for r in documents.select("doc_id", "text", "lang", "source").collect() if r.text and len(r.text) > 40]
    held = {r.doc_id for r in rows if r.doc_id % 2}
    df = spark.createDataFrame([(r.doc_id, r.text, None if r.doc_id in held else r.lang, r.source) for r in rows], "doc_id bigint, text string, lang string, source string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    got = {r.id.doc_id: r.lang for r in language.fused(language.evidence_rows(df, pages), df.select("doc_id", "text", "lang")).collect()}
    right = [got[r.doc_id] == r.lang for r in rows if r.doc_id in held]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)


def test_language_against_brute_force(spark):
    docs = [(i, text, lang, "h") for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "FR-ca"), ("der hund und die katze", "de_AT"), ("the house and the tree", "EN"), ("das haus und der baum", "de"), ("x", "not a code")])]
    webs = [(0, "http://a.s.org/1", "<html lang=fr><p>le chien"), (1, "http://a.s.org/2", "<p>the tree"), (2, "http://b.s.org/1", "<html lang=fr>la maison"), (3, "http://c.t.com/", "zz"), (4, None, "und"), (5, "http://a.s.org/3", "zz")]
    d = spark.createDataFrame(docs, "doc_id int, text string, lang string, source string")
    w = spark.createDataFrame(webs, "page_id bigint, url string, html string")
    codes = ["en", "fr", "de", "en", "de", None]
    rows = [(t, c, "", "h", "h") for (_, t, _, _), c in zip(docs, codes, strict=True)]
    rows += [(" le chien", "fr", ".org", "s.org", "a.s.org"), (" the tree", None, ".org", "s.org", "a.s.org"), (" la maison", "fr", ".org", "s.org", "b.s.org"), ("zz", None, ".com", "t.com", "c.t.com"), ("und", None, ".", "", ""), ("zz", None, ".org", "s.org", "a.s.org")]
    rows[6] = ("  le chien", *rows[6][1:])  # a tag leaves a space
    want = plain_language(rows, [(t, c) for (_, t, _, _), c in zip(docs, codes, strict=True) if c])
    got = {(r.id.doc_id, r.id.page_id): r for r in language.fused(language.evidence_rows(d, w), d.select("doc_id", "text", "lang")).collect()}
    keys = [(i, None) for i in range(6)] + [(None, i) for i in range(6)]
    for k, p in zip(keys, want, strict=True):
        assert got[k].lang == max(sorted(p), key=p.get) and abs(got[k].probability - max(p.values())) < 1e-9


def test_pages_are_scanned_in_linear_time():
    for page in ("<html " * 200_000, "<script>" * 200_000, "<!--" * 200_000, "<" * 10**6, "<html " * 200_000 + ">", "<style></styl" * 100_000, "&" * 10**6):
        began = time.perf_counter()
        language.scanned(page)
        assert time.perf_counter() - began < 2
    assert language.scanned("a<!-- <p> -->b<SCRIPT x>c</scripT >d<style>e</style>f<br>g &amp; h") == ("a b d f g & h", None)
    assert language.scanned("<p>x</p><HTML data-x=1 LANG = 'EN-us'>y<html lang=de>") == ("  x   y ".replace("  x   y ", " x  y "), "en")
    assert language.scanned("x<script>never closed")[0] == "x " and language.scanned("1 < 2")[0] == "1  < 2"


def test_host_prior_decides_short_texts(spark):
    """Of equal evidence in the text, the host's other pages decide."""
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " * 20, "aa", "h", 0) for i in range(5)] + [(i, "uno dos tres cuatro " * 20, "bb", "h", 0) for i in range(5, 10)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    pages = spark.createDataFrame([(i, "http://x.site.org/1", "alpha beta gamma delta") for i in range(6)] + [(i, "http://y.other.org/1", "uno dos tres cuatro") for i in range(6, 12)] + [(100, "http://x.site.org/2", "zz"), (101, "http://y.other.org/2", "zz")], "page_id bigint, url string, html string")
    got = {r.id.page_id: r.lang for r in language.fused(language.evidence_rows(docs, pages), docs.select("doc_id", "text", "lang")).collect() if r.id.page_id is not None}
    assert got[100] == "aa" and got[101] == "bb"
