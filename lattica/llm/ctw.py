"""LM scoring by context-tree weighting.

Texts (UTF-8, A-Z lowered, a zero byte as the end) are coded byte by byte, each byte as eight binary decisions, first bit first. For each decision there is a context tree over the bytes before: a node for every context of up to `depth` bytes, with counts of zeros and ones and the Krichevsky-Trofimov block probability of them. A node's weighted probability is half its own plus half the product of its children's, so a node stops with the posterior weight of its own half; the probability of a bit mixes the Krichevsky-Trofimov estimates of all depths along the context by these weights. A node whose longer context was never seen in training is a leaf. The code length is minus the sum of the logarithms.

Counts come from all training documents: a table of (context, byte) strings, summed in each task, then by key. The strings of all other documents are in it with a count of zero, so every byte that is to be scored has its logarithm computed once, and scoring is one table lookup a byte. `depth` is the same at every size. The table stays distributed, dealt by the LOW nearest context bytes: all nodes of that depth and deeper are worked out beside their strings, and only the nodes before them, 65,280 at most, meet on the driver. The strings that occur most, MAX_STRINGS at most, are broadcast; all others are joined in a shuffle, once for each document they are in.

Base score: token counts over all training documents by add-one. The most frequent tokens, HEAVY at most, are broadcast; all others join the counts in a shuffle, so no frequent token is a hot key and nothing unbounded is broadcast.

Defined results: a null text is empty and has one token, its end; a null id counts as the empty text for the split; repeated rows count and are scored each by itself; without training documents the estimates are those of empty counts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, column, materialize, read

DEPTH, MAX_STRINGS, HEAVY = 4, 1_000_000, 100_000
#: Context bytes by which strings are dealt, and strings of whole contexts that are worked out at once.
LOW, MANY = 2, 1 << 19
FOLDS, HELD_OUT = 7, 2
#: Bytes of text that are taken and whose strings are sorted at once, and different strings that a task holds before it emits them.
CHUNK, RUNS = 1 << 21, 1 << 22


def split(docs: DataFrame) -> DataFrame:
    """id, held_out, text (null as empty)."""
    name = F.coalesce(column(docs, "doc_id").cast("string"), F.lit(""))
    held = F.crc32(name.cast("binary")) % FOLDS == HELD_OUT
    return docs.select(column(docs, "doc_id").alias("id"), held.alias("held_out"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))


def strings(texts: list[bytes], depth: int, before: list[bytes] | None = None) -> np.ndarray:
    """(context, byte) of each byte, as numbers: the nearest context byte above the byte itself, the farthest on top. `before`: the `depth` bytes that precede each text; without it, texts are whole: each begins in a context of zeros and ends with a zero."""
    if before is None:
        texts, before = [t + b"\0" for t in texts], [b"\0" * depth] * len(texts)
    raw = np.frombuffer(b"".join(x for pair in zip(before, texts, strict=True) for x in pair), np.uint8)
    out = raw.astype(np.int64)
    for d in range(1, depth + 1):
        far = raw[:-d].astype(np.int64)
        far <<= 8 * d
        out[d:] |= far
    sizes = np.array([[depth, len(t)] for t in texts], np.int64).ravel()
    return out[np.repeat(np.tile([False, True], len(texts)), sizes)]


def pieces(texts: list[bytes], depth: int, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For about `most` bytes at once: the text that each string is of, the strings. Longer texts are cut, each cut with the bytes before it."""
    of: list[int] = []
    some: list[bytes] = []
    before: list[bytes] = []
    size, few = 0, 1 << (63 - 8 * (depth + 1))

    def done() -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(of, [len(x) for x in some]), strings(some, depth, before)

    for i, t in enumerate(texts):
        body = t + b"\0"
        for at in range(0, len(body), most):
            of.append(i)
            some.append(body[at : at + most])
            before.append((b"\0" * depth + body[max(0, at - depth) : at])[-depth:] if depth else b"")
            size += len(some[-1])
            if size >= most or len(of) == few:
                yield done()
                of, some, before, size = [], [], [], 0
    if of:
        yield done()


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text: what a task holds goes by bytes, not by Spark's number of rows in a batch. A longer text is a batch of its own."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def lowered(texts: pa.Array) -> list[bytes]:
    return pc.ascii_lower(texts).cast(pa.binary()).to_pylist()


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of keys with columns of counts, added up by key."""
    k, n = np.concatenate(keys), np.concatenate(counts, axis=1)
    order = np.argsort(k, kind="stable")  # merges the runs
    k = k[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(n[:, order], first, axis=1)


def string_counts(rows: DataFrame, depth: int) -> DataFrame:
    """key, n, m: how often each string occurs in training texts (0 for those of other texts alone, which are there to have their logarithm computed), and in all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        merged, fresh = 0, 0  # strings of the first run, which is added up, and of the others

        def done() -> pa.RecordBatch:
            k, n = summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[0]), pa.array(n[1])], ["key", "n", "m"])

        for b in slices(batches, 1):
            held = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            texts = lowered(b.column(1))
            for out in (False, True):
                for _, grams in pieces([t for t, h in zip(texts, held, strict=True) if h == out], depth):
                    k, n = np.unique(grams, return_counts=True)
                    keys.append(k)
                    counts.append(np.array([n * (not out), n]))
                    fresh += len(k)
                    if fresh > max(CHUNK // 4, min(merged, RUNS // 2)):  # so the runs are twice the different strings, not all that came
                        k, n = summed(keys, counts)
                        keys, counts, merged, fresh = [k], [n], len(k), 0
                        if merged > RUNS // 2:
                            yield done()
                            keys, counts, merged = [], [], 0
        if keys:
            yield done()

    return arrow_map(rows.select("held_out", "text"), work, "key long, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series seven steps up."""
    y = x + 7
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(np.pi)


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, low: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strings of each depth from `low` on: themselves, where the full strings are among them, their counts."""
    out = []
    for d in range(low, depth + 1):
        short, where = np.unique(keys & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
        out.append((short, where, np.bincount(where, counts, len(short))))
    return out


def nodes(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bit: int) -> tuple[list[tuple], list[np.ndarray], np.ndarray]:
    """The nodes of one decision: for each level (node, zeros, ones, where the full strings are among them) and the posterior weight of stopping there; the first level's weighted log probabilities."""
    path = []
    for short, where, n in found:  # a node is the context and the bits of the byte before the decision
        node = short >> (8 - bit)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
        one = (short >> (7 - bit) & 1).astype(np.float64)
        ones = np.add.reduceat(n * one, first) if len(first) else np.empty(0)
        both = np.add.reduceat(n, first) if len(first) else np.empty(0)
        of = (np.cumsum(np.r_[True, node[1:] != node[:-1]]) - 1)[where] if len(node) else where
        path.append((node[first], both - ones, ones, of))
    stop: list[np.ndarray] = [np.empty(0)] * len(path)
    weighted = None
    for d in range(len(path) - 1, -1, -1):
        node, zeros, ones, of = path[d]
        own = block(zeros, ones)
        if weighted is None:
            stop[d], weighted = np.ones(len(node)), own
            continue
        parent = np.empty(len(path[d + 1][0]), np.int64)
        parent[path[d + 1][3]] = of
        stop[d], weighted = stopping(own, np.bincount(parent, weighted, len(node)))
    return path, stop, weighted


def stopping(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's posterior weight of its own half and its weighted log probability."""
    mixed = np.logaddexp(own, below) + np.log(0.5)
    return np.exp(np.log(0.5) + own - mixed), mixed


#: For each decision, the nodes of each depth before `low`, by number: zeros, ones, posterior weight of stopping.
Above = list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def parts_above(keys: np.ndarray, counts: np.ndarray, depth: int, low: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each decision: its bit, the nodes of depth `low` - 1 and what these strings add to their zeros, ones and children's weighted log probabilities. The strings of a context of `low` bytes must be together."""
    found = levels(keys, counts, depth, low)
    for bit in range(8):
        path, _, weighted = nodes(found, bit)
        node, zeros, ones, _ = path[0]
        up, where = np.unique(node & ((1 << (8 * (low - 1) + bit)) - 1), return_inverse=True)
        yield bit, up, *(np.bincount(where, x, len(up)) for x in (zeros, ones, weighted))


def joined_above(bit: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, low: int) -> Above:
    """The levels before `low` from the sums of `parts_above`, as arrays with a place for every node there can be."""
    out = []
    for k in range(8):
        of = bit == k
        place = lambda x, of=of, k=k: np.bincount(node[of], x[of], 1 << (8 * (low - 1) + k))
        z, o, w = place(zeros), place(ones), place(below)
        rows = []
        for d in range(low - 1, -1, -1):
            stop, mixed = stopping(block(z, o), w)
            rows.append((z, o, stop))
            if d:  # contexts stand above the bits, the farthest byte on top
                z, o, w = (x.reshape(256, -1).sum(axis=0) for x in (z, o, np.where(z + o > 0, mixed, 0.0)))
        out.append(rows[::-1])
    return out


def string_logs(keys: np.ndarray, counts: np.ndarray, depth: int, above: Above | None = None) -> np.ndarray:
    """Log probability of the last byte of each string after its context. With `above`, the strings are those of some contexts of as many bytes as it has levels."""
    total = np.zeros(len(keys))
    low = len(above[0]) if above else 0
    found = levels(keys, counts, depth, low)
    for bit in range(8):
        path, stop, _ = nodes(found, bit)
        chain = [(zeros, ones, s, (keys & ((1 << (8 * (d + 1))) - 1)) >> (8 - bit)) for d, (zeros, ones, s) in enumerate(above[bit] if above else [])]
        chain += [(zeros, ones, s, of) for (_, zeros, ones, of), s in zip(path, stop, strict=True)]
        p = None
        bits = keys >> (7 - bit) & 1
        for zeros, ones, s, of in reversed(chain):
            seen = (zeros + ones)[of]
            kt = (np.where(bits == 1, ones[of], zeros[of]) + 0.5) / (seen + 1)
            if p is None:
                p, deeper = kt, seen
            else:
                w = np.where(deeper > 0, s[of], 1.0)
                p, deeper = w * kt + (1 - w) * p, seen
        total += np.log(p)
    return total


def commonest(df: DataFrame, times: str, most: int) -> Column:
    """Whether a row is among the commonest, `most` at most, by steps of an eighth of a power of two; a few hundred steps, whatever the corpus."""
    step = F.floor(F.log2(times) * 8)
    least, left = math.inf, most
    for r in df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        if (left := left - r.n) < 0:
            break
        least = r.step
    return step >= F.lit(float(least))


def fit(rows: DataFrame, depth: int = DEPTH, most: int = MAX_STRINGS) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """The strings that occur most, `most` at most, sorted, and their logs; the others (key, log) as a table, None where there are none."""
    low = min(LOW, depth)
    table = materialize(string_counts(rows, depth), "strings")
    n = table.count()
    group = F.expr(f"shiftright(key, 8) & {(1 << (8 * low)) - 1}")
    tasks = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // MANY))
    dealt = table.repartition(tasks, group).sortWithinPartitions(group)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """key, n, m of whole contexts, about MANY strings or one context at once."""
        have: list[np.ndarray] = []
        size = 0
        for b in batches:
            have.append(np.array([b.column(i).to_numpy() for i in range(3)]))
            size += b.num_rows
            if size >= MANY:
                got = np.concatenate(have, axis=1)
                of = got[0] >> 8 & ((1 << (8 * low)) - 1)
                cut = int(np.flatnonzero(of != of[-1])[-1]) + 1 if of[0] != of[-1] else 0
                if cut:
                    yield tuple(got[:, :cut])
                have, size = [got[:, cut:]], len(of) - cut
        if size:
            yield tuple(np.concatenate(have, axis=1))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts, _ in whole(batches):
            for bit, node, *sums in parts_above(keys, counts.astype(float), depth, low):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), bit)), *map(pa.array, (node, *sums))], ["bit", "node", "zeros", "ones", "below"])

    sums = arrow_map(dealt, parts, "bit long, node long, zeros double, ones double, below double").groupBy("bit", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    got = sums.toArrow()  # 256 * 255 rows at most
    above = joined_above(*(got[c].to_numpy() for c in ("bit", "node", "zeros", "ones", "below")), low)
    model = rows.sparkSession.sparkContext.broadcast(above)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts, times in whole(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times), pa.array(string_logs(keys, counts.astype(float), depth, model.value))], ["key", "m", "log"])

    scores = materialize(arrow_map(dealt, logs, "key long, m long, log double"), "string-logs")
    hot, cold = scores, None
    if n > most:
        often = commonest(scores, "m", most)
        hot, cold = scores.where(often), scores.where(~often).select("key", "log")
    kept = hot.select("key", "log").toArrow()
    keys, logs = kept["key"].to_numpy(), kept["log"].to_numpy()
    order = np.argsort(keys)
    return keys[order], logs[order], cold


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text that each word is of, the words (A-Z lowered)."""
    split_ = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # at \x20 and \x09-\x0D; empty ends are not words
    flat = split_.flatten()
    full = pc.not_equal(flat, "")
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split_).to_numpy(zero_copy_only=False))
    return of[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def token_counts(rows: DataFrame) -> DataFrame:
    """token, c: counts of words in training texts; the end is not among them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            found = words(b.column(0))[1].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], ["token", "c"])

    return arrow_map(rows.where("NOT held_out").select("text"), work, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def lists(owner: np.ndarray, tf: np.ndarray, values: pa.Array, name: str, n: int) -> pa.Array:
    """For each of n texts, structs of its values and how often it has them; owner is sorted."""
    pairs = pa.StructArray.from_arrays([values, pa.array(tf.astype(np.int64))], [name, "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pairs)


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)
    return first, np.diff(np.r_[first, len(sorted_)])


def byte_scores(texts: list[bytes], keys: np.ndarray, logs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the logs of each text's strings; text, string and times of the strings that are not among `keys` (sorted)."""
    total = np.zeros(len(texts))
    missed = [np.empty((3, 0), np.int64)]
    for of, grams in pieces(texts, depth):
        base = int(of[0])
        bits = max(1, int(of[-1] - base).bit_length())
        both = grams << bits | (of - base)
        both.sort()  # by string, then by text: each string is looked up once
        gram, of = both >> bits, (both & ((1 << bits) - 1)) + base
        first, n = runs(gram)
        at = np.minimum(np.searchsorted(keys, gram[first]), max(len(keys) - 1, 0))
        found = keys[at] == gram[first] if len(keys) else np.zeros(len(first), bool)
        value = np.where(found, logs[at], 0.0) if len(keys) else np.zeros(len(first))
        total += np.bincount(of, np.repeat(value, n), len(texts))
        miss = np.flatnonzero(np.repeat(~found, n))
        start, tf = runs(both[miss])
        missed.append(np.array([of[miss][start], gram[miss][start], tf]))
    got = np.concatenate(missed, axis=1)
    return total, *got[:, np.argsort(got[0], kind="stable")]


def scored(docs: DataFrame, depth: int = DEPTH, most: int = MAX_STRINGS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row."""
    spark = docs.sparkSession
    rows = split(docs)
    counts = materialize(token_counts(rows), "tokens")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.where("NOT held_out").count()
    n, v = sums[0] + ends, sums[1] + (ends > 0)
    top = (counts if sums[1] <= heavy else counts.where(commonest(counts, "c", heavy))).toArrow().combine_chunks()  # `heavy` rows at most
    keys, logs, others = fit(rows, depth, most)
    tokens = pa.concat_arrays(top["token"].chunks) if top.num_rows else pa.array([], pa.string())
    model = spark.sparkContext.broadcast((keys, logs, tokens, np.log10(top["c"].to_numpy() + 1.0)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, tokens, token_logs = model.value
        end = float(np.log10(ends + 1))
        for b in slices(batches, 2):
            size = b.num_rows
            texts = lowered(b.column(2))
            score, owner, missed, tf = byte_scores(texts, keys, logs, depth)
            cold = lists(owner, tf, pa.array(missed), "key", size)
            of, found = words(b.column(2))
            coded = found.dictionary_encode()
            index, here = coded.indices.to_numpy(), coded.dictionary
            place = pc.fill_null(pc.index_in(here, value_set=tokens), -1).to_numpy()
            known = place >= 0
            value = np.where(known, token_logs[place], 0.0) if len(tokens) else np.zeros(len(here))
            base = np.bincount(of, value[index], size) + end
            n_known = np.bincount(of, known[index], size).astype(np.int64) + (ends > 0)
            left = np.flatnonzero(~known[index])
            pair = np.sort(of[left] * max(len(here), 1) + index[left])
            first, times = runs(pair)
            rest = lists(pair[first] // max(len(here), 1), times, here.take(pa.array(pair[first] % max(len(here), 1))), "token", size)
            n_bytes = np.array([len(t) for t in texts], np.int64)
            cols = [b.column(0), b.column(1), pa.array(np.bincount(of, minlength=size).astype(np.int64) + 1), pa.array(n_known), pa.array(base), pa.array(score / np.log(10)), pa.array(n_bytes), rest, cold]
            yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "rest", "cold"])

    kind = rows.schema["id"].dataType.simpleString()
    first = arrow_map(rows, work, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rest array<struct<token:string,tf:bigint>>, cold array<struct<key:bigint,tf:bigint>>")
    first = materialize(first.withColumn("rid", F.monotonically_increasing_id()), "scores")
    rare = first.select("rid", F.explode("rest").alias("r")).select("rid", "r.token", "r.tf")
    tail = rare.join(counts, "token").groupBy("rid").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail"))
    whole = first.drop("rest", "cold").join(tail, "rid", "left")
    score = F.col("score")
    if others is not None:
        missed = first.select("rid", F.explode("cold").alias("r")).select("rid", "r.key", "r.tf")
        log = F.coalesce("log", F.raise_error(F.lit("a string that was never counted")).cast("double"))
        whole = whole.join(missed.join(others, "key", "left").groupBy("rid").agg(F.sum(F.col("tf") * log / float(np.log(10))).alias("cold")), "rid", "left")
        score = score + F.coalesce("cold", F.lit(0.0))
    # c is 0 for tokens that no training text has, so they add nothing but the denominator.
    base = F.col("base") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return whole.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), "n_bytes", (-score * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return scored(read(spark, sf_dir, "documents"))
