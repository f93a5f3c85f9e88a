"""Running and sliding aggregates, positions and as-of joins without a single ordered partition.

Rows are cut into contiguous buckets of an order key; windows run inside a bucket, and what stands before a bucket comes from one row per bucket. Whole-table windows would put every row into one task.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 16
#: Buckets into which quantiles cut a key that is not a dense row number.
QUANTILES = 256
#: Rows of a sample that gives bounds.
SAMPLE = 1 << 13

AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _joined(how: str, a: Column, b: Column) -> Column:
    if how == "count":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if how == "sum":
        return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.least(a, b) if how == "min" else F.greatest(a, b)


def running(df: DataFrame, row: str, wanted: dict[str, tuple[str, Column]], reverse: bool = False, bucket_rows: int = BUCKET_ROWS, bucket: Column | None = None, own_row: bool = True, base: DataFrame | None = None) -> DataFrame:
    """Adds, by name, an aggregate ("sum", "count", "min" or "max") of an expression over this row (if own_row) and all rows before it (after it, if reverse). row: a dense or sparse number; rows that tie in it are taken one after the other. base: the same rows without columns that were added; totals come from it where the expressions allow, so that a chain of such steps does not double its plan at each."""
    at = F.floor(F.col(row) / bucket_rows) if bucket is None else bucket
    cut = df.withColumn("__b", at)
    order, outer = (F.desc(row), F.desc("__b")) if reverse else (F.asc(row), F.asc("__b"))
    own = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own_row else -1)
    names = list(wanted)
    for i, n in enumerate(names):
        cut = cut.withColumn(f"__e{i}", wanted[n][1])
    whole = cut
    if base is not None and resolves(base, [at, *[e for _, e in wanted.values()]]):
        whole = base.select(at.alias("__b"), *[wanted[n][1].alias(f"__e{i}") for i, n in enumerate(names)])
    totals = whole.groupBy("__b").agg(*[AGGREGATES[wanted[n][0]](f"__e{i}").alias(f"__t{i}") for i, n in enumerate(names)])
    before = Window.orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carry = totals.select(F.col("__b").alias("__c"), *[(F.sum if wanted[n][0] == "count" else AGGREGATES[wanted[n][0]])(f"__t{i}").over(before).alias(f"__t{i}") for i, n in enumerate(names)])
    out = cut.select("*", *[AGGREGATES[wanted[n][0]](f"__e{i}").over(own).alias(f"__o{i}") for i, n in enumerate(names)]).join(F.broadcast(carry), F.col("__b").eqNullSafe(F.col("__c")))  # a row per bucket
    return out.select(*[c for c in df.columns if c not in names], *[_joined(wanted[n][0], F.col(f"__o{i}"), F.col(f"__t{i}")).alias(n) for i, n in enumerate(names)])


def sliding(df: DataFrame, row: str, lo: int, hi: int, wanted: dict[str, Column], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds, by name, aggregate expressions over the rows whose number lies lo to hi after this one's (negative: before)."""
    size = max(bucket_rows, 2 * (abs(lo) + abs(hi) + 1))
    at = lambda c: F.floor(c / size)
    own = at(F.col(row))
    copies = df.withColumn("__own", own).withColumn("__b", F.explode(F.array_distinct(F.array(own, at(F.col(row) - hi), at(F.col(row) - lo)))))
    w = Window.partitionBy("__b").orderBy(F.col(row).cast("bigint")).rangeBetween(lo, hi)
    out = copies.select(*[c for c in df.columns if c not in wanted], "__own", "__b", *[e.over(w).alias(n) for n, e in wanted.items()])
    return out.where(F.col("__own") == F.col("__b")).drop("__own", "__b")


def resolves(df: DataFrame, cols: list[Column]) -> bool:
    """Whether a DataFrame has all that the expressions name."""
    try:
        df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    except AnalysisException:
        return False
    return True


def running_matched(df: DataFrame, row: str, own: list[Column], asked: list[Column], wanted: dict[str, tuple[str, Column]], reverse: bool = False, bucket_rows: int = BUCKET_ROWS, base: DataFrame | None = None) -> DataFrame:
    """Like `running`, over those of the rows whose `own` keys equal this row's `asked` keys; NULL keys equal nothing. No key meets in one task: its rows are cut into buckets of row numbers."""
    base = base if base is not None and resolves(base, [*own, *asked, *[e for _, e in wanted.values()]]) else df
    names, keys = list(wanted), [f"__k{i}" for i in range(len(own))]
    tests = [f"__e{i}" for i in range(len(names))]
    cut = F.floor(F.col(row) / bucket_rows).alias("__b")
    order = F.col(row).alias("__r")
    data = base.select(*[k.alias(n) for k, n in zip(own, keys, strict=True)], order, cut, F.lit(0).alias("__side"), *[wanted[n][1].alias(t) for n, t in zip(names, tests, strict=True)]).dropna(subset=keys)
    probes = df.select(*[k.alias(n) for k, n in zip(asked, keys, strict=True)], order, cut, F.lit(1).alias("__side"), F.struct(*df.columns).alias("__row"))
    rows = data.unionByName(probes, allowMissingColumns=True)
    by, outer = (F.desc("__r"), F.desc("__b")) if reverse else (F.asc("__r"), F.asc("__b"))
    inside = Window.partitionBy(*keys, "__b").orderBy(by, "__side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)  # a row per key and bucket
    pairs = base.select(*[k.alias(n) for k, n in zip(asked, keys, strict=True)], cut)
    totals = data.unionByName(pairs, allowMissingColumns=True).groupBy(*keys, "__b").agg(*[AGGREGATES[wanted[n][0]](t).alias(f"__t{i}") for i, (n, t) in enumerate(zip(names, tests, strict=True))])
    carry = totals.select(*[F.col(k).alias(k + "c") for k in keys], F.col("__b").alias("__c"), *[(F.sum if wanted[n][0] == "count" else AGGREGATES[wanted[n][0]])(f"__t{i}").over(before).alias(f"__t{i}") for i, n in enumerate(names)])
    met = F.col("__b").eqNullSafe(F.col("__c"))
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(k + "c"))
    out = rows.select("*", *[AGGREGATES[wanted[n][0]](t).over(inside).alias(f"__o{i}") for i, (n, t) in enumerate(zip(names, tests, strict=True))]).where("__side = 1").join(carry, met)
    return out.select(*[F.col("__row")[c].alias(c) for c in df.columns if c not in names], *[_joined(wanted[n][0], F.col(f"__o{i}"), F.col(f"__t{i}")).alias(n) for i, n in enumerate(names)])


@functools.lru_cache(maxsize=64)
def _remembered(key: tuple[int, str, int]) -> list[list[float]]:
    """A place for the bounds of a plan's column; they steer the cutting alone, never a result."""
    return []


def shares_of(df: DataFrame, key: str, quantiles: int = QUANTILES) -> list[float]:
    """Approximate quantiles of a numeric column in order, `quantiles` numbers on the driver; a number that many rows have stands in several places. Worked out once for equal plans."""
    place = _remembered((df.semanticHash(), key, quantiles))
    if not place:
        place.append(sorted(df.select(F.col(key).cast("double").alias(key)).approxQuantile(key, [i / quantiles for i in range(1, quantiles)], 0.001)))
    return place[0]


def quantiles_of(df: DataFrame, key: str, quantiles: int = QUANTILES) -> list[float]:
    """The distinct ones of `shares_of`."""
    return sorted(set(shares_of(df, key, quantiles)))


def bucket_of(key: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at or below the key, by binary search; -1 for NULL."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    whole = F.array(*map(F.lit, bounds))
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get(whole, at + step - 1) <= key, step).otherwise(0))
    return F.when(key.isNull(), -1).otherwise(found)


def quantile_bucket(df: DataFrame, key: str, quantiles: int = QUANTILES) -> Column:
    """A bucket number that grows with a numeric key, from approximate quantiles."""
    return bucket_of(F.col(key).cast("double"), quantiles_of(df, key, quantiles))


def at_shares(df: DataFrame, value: str, share: float) -> Column:
    """The number at a share of the way through all numbers in order, between neighbours where it falls between two; a scalar. Counts by bucket tell which one or two buckets hold the place, and only their distinct numbers are ordered."""
    some = df.select(F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    cut = some.select("__v", quantile_bucket(some, "__v").alias("__b"))
    counts = cut.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)  # one row per bucket
    placed = counts.select(F.col("__b").alias("__c"), (F.sum("__n").over(upto) - F.col("__n")).alias("__before"), F.sum("__n").over(upto).alias("__upto"), (F.sum("__n").over(Window.partitionBy()) - 1).alias("__last"))
    p = F.lit(share) * F.col("__last")
    low, high = F.floor(p), F.ceil(p)
    holds = lambda at: (F.col("__before") <= at) & (at < F.col("__upto"))
    wanted = placed.where(holds(low) | holds(high))
    inside = Window.partitionBy("__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    each = cut.join(F.broadcast(wanted), F.col("__b") == F.col("__c")).groupBy("__b", "__v", "__before", "__last").agg(F.count(F.lit(1)).alias("__n"))
    each = each.withColumn("__to", F.col("__before") + F.sum("__n").over(inside))
    at = lambda place: F.max(F.when((place < F.col("__to")) & (place >= F.col("__to") - F.col("__n")), F.col("__v")))
    ends = each.agg(at(low).alias("a"), at(high).alias("z"), F.max(p - F.floor(p)).alias("f"))
    return ends.select(F.col("a") + (F.col("z") - F.col("a")) * F.col("f")).scalar()


def directed(keys: list[Column], down: list[bool]) -> list[Column]:
    """Sort orders; NULL last ascending, first descending."""
    return [k.desc_nulls_first() if d else k.asc_nulls_last() for k, d in zip(keys, down, strict=True)]


def cut_by(df: DataFrame, order: list[Column], quantiles: int = QUANTILES, down: list[bool] | None = None) -> Column:
    """A bucket number that grows with several ascending keys of any types, ties of the first split by the next: the bounds stand evenly in a sorted sample of SAMPLE rows. They steer the cutting alone, never a result. down: which keys descend instead; then the order is that of `directed`."""
    keys = df.select(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    rows = keys.orderBy(F.rand(17)).limit(SAMPLE).orderBy(*(keys.columns if down is None else directed([F.col(k) for k in keys.columns], down))).collect()
    bounds = [rows[len(rows) * i // quantiles] for i in range(1, quantiles)] if rows else []
    kinds = [f.dataType for f in keys.schema.fields]
    distinct = sorted({tuple(r): i for i, r in enumerate(bounds)}.items(), key=lambda x: x[1])
    made = [F.struct(*[F.lit(v).cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(r, kinds, strict=True))]) for r, _ in distinct]
    if not made:
        return F.lit(0)
    steps = [1 << k for k in range(len(made).bit_length() - 1, -1, -1)]
    whole, own = F.array(*made), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])

    def reached(bound: Column) -> Column:
        if down is None:
            return bound <= own
        got = bound.isNotNull()  # beyond the last bound there is none
        for i, d in reversed(list(enumerate(down))):
            x, y = bound[f"k{i}"], own[f"k{i}"]
            first = F.when(x.isNull(), F.lit(d)).when(y.isNull(), F.lit(not d)).otherwise(x > y if d else x < y)
            got = F.when(x.eqNullSafe(y), got).otherwise(first)
        return bound.isNotNull() & got

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(reached(F.get(whole, at + step - 1)), step).otherwise(0))


def numbered(df: DataFrame, order: list[str] | list[Column], row: str = "_row", first: int = 1, down: list[bool] | None = None) -> DataFrame:
    """Adds a dense row number by the given order; with `down`, by that of `directed`. Rows are cut by all order columns, so that no task sorts all rows, however many tie in the first. The rows are evaluated more than once, so an order column must be one of their values: a number that Spark gives by partition differs from one evaluation to the next."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = df.withColumn("__b", cut_by(df, keys, down=down))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carry = cut.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__b").orderBy(*(keys if down is None else directed(keys, down)))
    return cut.withColumn("__i", F.row_number().over(own)).join(F.broadcast(carry), F.col("__b") == F.col("__c")).select(*df.columns, (F.col("__i") + F.col("__before") + F.lit(first - 1)).cast("bigint").alias(row))


def ranks(df: DataFrame, value: str, out: str, descending: bool = True) -> DataFrame:
    """Adds the competition rank of a number among all rows. Only distinct values with their counts are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(counts, "__v", {"__upto": ("sum", F.col("__n"))}, reverse=descending, bucket=quantile_bucket(counts, "__v"))
    placed = placed.select("__v", (F.col("__upto") - F.col("__n") + 1).alias(out))
    return df.join(placed, F.col(value) == F.col("__v"), "left").drop("__v")


def asof(df: DataFrame, key: str, table: DataFrame, table_key: str, values: list[str], order: str, forward: bool = False, last_tie: bool = True, prefix: str = "", base: DataFrame | None = None, asked: Column | None = None) -> DataFrame:
    """Adds the table's `values` at the largest table key <= key (the smallest >= key, if forward). Of equal table keys the one of the largest `order` wins if last_tie, else of the smallest. Both sides are cut at quantiles of either side's keys, and rows of a key that many have are dealt over several parts by their hash, each with a copy of the bucket's table rows (twice the table in all, at most); a bucket also gets the winner of the buckets before it. base, asked: rows and expression that have the same keys, to spare `df` a second evaluation."""
    pick = F.max_by if last_tie else F.min_by
    right = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).cast("double").alias("__k")).agg(pick(F.struct(*values), F.col(order)).alias("__v"))
    keys = table.where(F.col(table_key).isNotNull()).select(F.col(table_key).cast("double").alias("__k"))
    probes = base.select(asked.cast("double").alias("__k")) if base is not None and resolves(base, [asked]) else df.select(F.col(key).cast("double").alias("__k"))
    shares = shares_of(probes, "__k")
    bounds = sorted({*quantiles_of(keys, "__k"), *shares})
    parts = [1, *[max(1, shares.count(x)) for x in bounds]]  # of the bucket that begins at each bound
    bucket = lambda c: bucket_of(c, bounds)
    step = -1 if forward else 1
    left = df.withColumn("__k", F.col(key).cast("double"))
    dealt = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    at = F.when(F.col("__k").isNull(), F.pmod(dealt, F.lit(len(parts))).cast("int")).otherwise(bucket(F.col("__k")))  # NULL keys find nothing anywhere
    left = left.select(F.struct(*df.columns).alias("__row"), "__k", F.lit(None).cast(right.schema["__v"].dataType).alias("__v"), at.alias("__b"), F.lit(1).alias("__side"), dealt.alias("__p"))
    cut = right.withColumn("__b", bucket(F.col("__k")))
    copies = F.get(F.array(*map(F.lit, parts)), F.col("__b"))
    left = left.withColumn("__p", F.pmod(F.col("__p"), copies).cast("int"))
    ends = cut.groupBy("__b").agg((F.min_by if forward else F.max_by)("__v", "__k").alias("__e"))
    buckets = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__b")).join(ends, "__b", "left")
    edge = Window.orderBy(F.col("__b") * step).rowsBetween(Window.unboundedPreceding, -1)  # 2 * QUANTILES rows at most
    carry = buckets.select(F.col("__b").alias("__c"), F.last("__e", ignorenulls=True).over(edge).alias("__e"))
    rows = left.unionByName(cut.select(F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), "__k", "__v", "__b", F.lit(0).alias("__side"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("__p")))
    w = Window.partitionBy("__b", "__p").orderBy(F.col("__k") * step, "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("__m", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").join(F.broadcast(carry), F.col("__b") == F.col("__c"))
    found = F.when(F.col("__k").isNotNull(), F.coalesce("__m", "__e"))
    return met.select("__row.*", *[found[v].alias(prefix + v) for v in values])
