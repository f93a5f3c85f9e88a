"""Aggregates over ranges, order statistics and ranks.

Ranges give numbers and dates; text, Booleans and blanks in them are skipped. Ranges that a fill moves become windows or arrays in the row, all others scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import elementwise, moving
from lattica.functions.registry import function
from lattica.parser import FormulaError, Node, Unsupported
from lattica.plans import ordered
from lattica.refs import Range
from lattica.values import HOST, Val, first_error, numeric, to_int, to_num



def pieces(b, node: Node) -> tuple[Range | None, Val | None]:
    rng = b.as_range(node)
    return (rng, None) if rng is not None else (None, b.value(node))


def count_of(v: Val) -> Column:
    return F.count(numeric(v))


#: name -> (per column, how two parts join): aggregates that combine from parts.
PARTS: dict[str, tuple[Callable[[Val], Column], Callable[[Column, Column], Column]]] = {
    "SUM": (lambda v: F.coalesce(F.sum(numeric(v)), F.lit(0.0)), lambda a, b: a + b),
    "COUNT": (count_of, lambda a, b: a + b),
    "COUNTA": (lambda v: F.count(F.when(v.col.isNotNull() if v.err is None else v.col.isNotNull() | v.err.isNotNull(), 1)), lambda a, b: a + b),
    "COUNTBLANK": (lambda v: F.count_if(v.col.isNull() if v.err is None else v.col.isNull() & v.err.isNull()), lambda a, b: a + b),
    "MIN": (lambda v: F.min(numeric(v)), F.least),
    "MAX": (lambda v: F.max(numeric(v)), F.greatest),
}
#: The same as window functions.
WINDOWED: dict[str, Callable[[Val], Column]] = {
    "SUM": lambda v: F.sum(numeric(v)), "COUNT": count_of, "COUNTA": lambda v: F.count(F.when(v.col.isNotNull(), 1)),
    "COUNTBLANK": lambda v: F.count(F.when(v.col.isNull(), 1)), "MIN": lambda v: F.min(numeric(v)), "MAX": lambda v: F.max(numeric(v)),
}
#: name -> aggregate of stacked numbers, least count, error below it.
STACKED = {
    "MEDIAN": (F.median, 1, HOST), "STDEV": (F.stddev_samp, 2, HOST), "STDEVP": (F.stddev_pop, 1, HOST), "VAR": (F.var_samp, 2, HOST), "VARP": (F.var_pop, 1, HOST),
}


def range_error(region) -> Column | None:
    errs = [v.err for v in region.vals if v.err is not None]
    return region.df.agg(F.first(F.coalesce(*errs), ignorenulls=True)).scalar() if errs else None


def folded(b, name: str, args: tuple[Node, ...]) -> tuple[Column, Column | None]:
    """A combining aggregate over all arguments, and its error."""
    per, join = PARTS[name]
    cols, errs = [], []
    for a in args:
        if elementwise.ranges(b, a):
            numbers = name not in ("COUNTA", "COUNTBLANK")
            code = lambda v: F.lit(None).cast("string") if v.err is None else v.err
            arr = elementwise.in_window(b, a, lambda v: F.struct((numeric(v) if numbers else v.col).alias("v"), code(v).alias("e")), numbers)
            if arr is not None:
                got = F.filter(F.transform(arr, lambda x: F.when(x["e"].isNull(), x["v"])), lambda v: v.isNotNull())
                cols.append({"SUM": lambda: moving.total(got), "MIN": lambda: F.array_min(got), "MAX": lambda: F.array_max(got), "COUNTBLANK": lambda: F.size(arr).cast("bigint") - F.size(got)}.get(name, lambda: F.size(got).cast("bigint"))())
                errs.append(None if name.startswith("COUNT") else F.get(F.filter(F.transform(arr, lambda x: x["e"]), lambda e: e.isNotNull()), F.lit(0)))
                continue
            df, vals = elementwise.region(b, a, numbers)
            vals = [v if v.err is None or not name.startswith("COUNT") else Val(F.when(v.err.isNull(), v.col), v.kind) for v in vals]
            cols.append(df.agg(reduce(join, [per(x) for x in vals])).scalar())
            failing = [v.err for v in vals if v.err is not None]
            errs.append(df.agg(F.min_by(F.coalesce(*failing), F.when(F.coalesce(*failing).isNotNull(), F.col(elementwise.PLACE)))).scalar() if failing else None)
            continue
        rng, v = pieces(b, a)
        if v is not None:
            one = to_num(v)
            cols.append({"COUNT": lambda v=v, one=one: (F.lit(1) if v.kind in ("num", "date", "bool") else one.err.isNull().cast("int") if one.err is not None and v.err is None else F.lit(0)).cast("bigint"), "COUNTA": lambda v=v: F.lit(0 if v.kind == "blank" and v.err is None else 1).cast("bigint"), "COUNTBLANK": lambda: F.lit(0).cast("bigint")}.get(name, lambda one=one: one.col)())
            errs.append(None if name.startswith("COUNT") else one.err)
            continue
        move = b.moving(rng)
        if move is None:
            region = b.region(rng)
            cols.append(region.df.agg(reduce(join, [per(x) for x in region.vals])).scalar())
            errs.append(None if name.startswith("COUNT") else range_error(region))
            if name == "COUNTBLANK" and rng.start.row:
                cols.append(F.lit(rng.height * rng.width).cast("bigint") - region.df.agg(F.count(F.lit(1)) * len(region.vals)).scalar())
        else:
            cols.append(moved(b, name, rng, *move))
    return reduce(join, cols), first_error(*errs)


def moved(b, name: str, rng: Range, lo: int | None, hi: int | None) -> Column:
    """An aggregate over a range that a fill moves: within the row, sliding or running."""
    if not b.own(rng):
        if lo is None or hi is None:
            raise Unsupported(f"a range of another sheet with one end that stays: {rng}")
        w = moving.window(b, [rng], padded=True)
        if name in ("COUNTA", "COUNTBLANK"):
            filled = F.size(F.filter(w.each(lambda x, j: w.val(x, 0, j).col.isNotNull()), lambda x: x))
            return (filled if name == "COUNTA" else rng.height * rng.width - filled).cast("bigint")
        arr = moving.numbers(b, [rng])
        return {"SUM": lambda: moving.total(arr), "COUNT": lambda: F.size(arr).cast("bigint"), "MIN": lambda: F.array_min(arr), "MAX": lambda: F.array_max(arr)}[name]()
    vals = [b.sheet.val(c) for c in range(rng.start.col, rng.end.col + 1)]
    if lo == 0 and hi == 0:
        return in_row(name, vals)
    row = b.sheet.numbered_row(b)
    join = PARTS[name][1]
    names = [b.new() for _ in vals]
    if lo is not None and hi is not None:
        b.df = ordered.sliding(b.df, row, lo, hi, {n: WINDOWED[name](v) for n, v in zip(names, vals, strict=True)})
        out = reduce(join, [F.coalesce(F.col(n), F.lit(0)) if name in ("SUM", "COUNTBLANK") else F.col(n) for n in names])
        return out + F.lit((hi - lo + 1) * len(vals)).cast("bigint") - window_rows(b, row, lo, hi, len(vals)) if name == "COUNTBLANK" else out
    if (lo or 0) != 0 or (hi or 0) != 0:
        raise Unsupported(f"a range anchored at one end must end in its own row: {rng}")
    how, empty = {"SUM": ("sum", 0.0), "COUNT": ("count", 0), "COUNTA": ("count", 0), "MIN": ("min", None), "MAX": ("max", None)}.get(name, (None, None))
    if how is None:
        raise Unsupported(f"{name} has no running form")
    limit = F.col(row) >= rng.start.row if lo is None else rng.ends_after(F.col(row))
    cell = (lambda v: F.when(limit & v.col.isNotNull(), F.lit(1))) if name == "COUNTA" else (lambda v: F.when(limit, numeric(v)))
    b.df = ordered.running(b.df, row, {n: (how, cell(v)) for n, v in zip(names, vals, strict=True)}, reverse=lo is not None, base=b.sheet.df)
    parts = [F.col(n) if empty is None else F.coalesce(F.col(n), F.lit(empty)) for n in names]
    return reduce(join, parts)


def window_rows(b, row: str, lo: int, hi: int, width: int) -> Column:
    n = b.new()
    b.df = ordered.sliding(b.df, row, lo, hi, {n: F.count(F.lit(1))})
    return F.col(n) * width


def in_row(name: str, vals: list[Val]) -> Column:
    nums = [numeric(v) for v in vals]
    if name == "SUM":
        return reduce(lambda a, c: a + c, [F.coalesce(n, F.lit(0.0)) for n in nums])
    if name == "COUNT":
        return reduce(lambda a, c: a + c, [n.isNotNull().cast("bigint") for n in nums])
    if name in ("COUNTA", "COUNTBLANK"):
        return reduce(lambda a, c: a + c, [(v.col.isNotNull() if name == "COUNTA" else v.col.isNull()).cast("bigint") for v in vals])
    return nums[0] if len(nums) == 1 else F.least(*nums) if name == "MIN" else F.greatest(*nums)


for _name in ("SUM", "COUNT", "COUNTA", "COUNTBLANK"):

    @function(_name, 1, None)
    def _(b, args, _name=_name):
        col, err = folded(b, _name, args)
        return Val(col.cast("double") if _name == "SUM" else col.cast("bigint"), "num", err)


for _name in ("MIN", "MAX"):

    @function(_name, 1, None)
    def _(b, args, _name=_name):
        col, err = folded(b, _name, args)
        return Val(F.coalesce(col, F.lit(0.0)), "num", err)


@function("AVERAGE", 1, None)
def _average(b, args):
    rng = b.as_range(args[0]) if len(args) == 1 else None
    if rng is not None and rng.width == 1 and b.own(rng) and moving.slides(b, [rng]) and b.moving(rng) != (0, 0):  # both from one window
        t, k, v = b.new(), b.new(), b.sheet.val(rng.start.col)
        b.df = ordered.sliding(b.df, b.sheet.numbered_row(b), *b.moving(rng), {t: F.sum(numeric(v)), k: F.count(numeric(v))})
        return Val(F.try_divide(F.col(t), F.col(k)), "num", F.when(F.col(k) == 0, F.lit("#DIV/0!")))
    total, err = folded(b, "SUM", args)
    n, _ = folded(b, "COUNT", args)
    return Val(F.try_divide(total, n), "num", first_error(err, F.when(n == 0, F.lit("#DIV/0!"))))


def stacked(b, args: tuple[Node, ...]) -> tuple[DataFrame, Column | None]:
    """All numbers of the arguments as one column v."""
    frames, errs = [], []
    for a in args:
        if elementwise.ranges(b, a):
            df, vals = elementwise.region(b, a, True)
            nums = [numeric(x) for x in vals]
            frames.append(df.select((nums[0] if len(nums) == 1 else F.explode(F.array(*nums))).alias("v")))
            failing = [v.err for v in vals if v.err is not None]
            errs.append(df.agg(F.min_by(F.coalesce(*failing), F.when(F.coalesce(*failing).isNotNull(), F.col(elementwise.PLACE)))).scalar() if failing else None)
            continue
        rng, v = pieces(b, a)
        if v is not None:
            frames.append(b.sheet.df.sparkSession.range(1).select(to_num(v).col.alias("v")))
            errs.append(v.err)
            continue
        region = b.region(rng)
        nums = [numeric(x) for x in region.vals]
        frames.append(region.df.select((nums[0] if len(nums) == 1 else F.explode(F.array(*nums))).alias("v")))
        errs.append(range_error(region))
    return reduce(DataFrame.unionByName, frames).where("v IS NOT NULL"), first_error(*errs)


def row_array(b, args: tuple[Node, ...]) -> Column | None:
    """The numbers of ranges that a fill moves, in every row; None if no argument is such a range."""
    if any(elementwise.ranges(b, a) for a in args):
        if len(args) > 1:
            return None
        arr = elementwise.in_window(b, args[0], numeric)
        return None if arr is None else F.filter(arr, lambda x: x.isNotNull())
    both = [pieces(b, a) for a in args]
    ranges = [r for r, _ in both if r is not None]
    if b.base_row is None or all(b.moving(r) is None for r in ranges):
        return None
    if not moving.slides(b, ranges):
        raise Unsupported(f"no form for these ranges together in a fill: {', '.join(map(str, ranges))}")
    return moving.numbers(b, ranges, [to_num(v).col for r, v in both if r is None])


def middle(arr: Column) -> Column:
    srt, n = F.array_sort(arr), F.size(arr)
    return (F.get(srt, F.floor((n - 1) / 2).cast("int")) + F.get(srt, F.floor(n / 2).cast("int"))) / 2


for _name, (_how, _least, _code) in STACKED.items():

    @function(_name, 1, None)
    def _(b, args, _name=_name, _how=_how, _least=_least, _code=_code):
        rng = b.as_range(args[0]) if len(args) == 1 else None
        move = b.moving(rng) if rng is not None else None
        if move is not None and None not in move and move != (0, 0) and rng.width == 1 and b.own(rng) and _name != "MEDIAN":
            n, k = b.new(), b.new()
            v = b.sheet.val(rng.start.col)
            b.df = ordered.sliding(b.df, b.sheet.numbered_row(b), *move, {n: _how(numeric(v)), k: F.count(numeric(v))})
            return Val(F.col(n), "num", F.when(F.col(k) < _least, F.lit(_code)))
        if b.base_row is not None and (arr := row_array(b, args)) is not None:
            n = F.size(arr)
            mean = F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), n)
            square = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
            var = F.try_divide(square, n - (1 if _name in ("STDEV", "VAR") else 0))
            out = middle(arr) if _name == "MEDIAN" else F.sqrt(var) if _name.startswith("STDEV") else var
            return Val(F.when(n >= _least, out), "num", F.when(n < _least, F.lit(_code)))
        df, err = stacked(b, args)
        n = df.agg(F.count("v")).scalar()
        out = ordered.at_shares(df, "v", 0.5) if _name == "MEDIAN" else df.agg(_how("v")).scalar()
        return Val(out, "num", first_error(err, F.when(n < _least, F.lit(_code))))


def kth(largest: bool):
    def compile_(b, args):
        k = to_num(b.value(args[1]))
        if (arr := row_array(b, args[:1])) is not None:
            place = F.floor(k.col).cast("int")
            ok = (place >= 1) & (place <= F.size(arr))
            out = F.get(F.sort_array(arr, not largest), F.when(ok, place - 1))
            return Val(out, "num", first_error(k.err, F.when(~ok, F.lit("#NUM!"))))
        df, err = stacked(b, args[:1])
        if isinstance(b.constant(args[1]), int | float):
            n = int(b.constant(args[1]))
            if n < 1:
                return Val(F.lit(None).cast("double"), "num", F.lit("#NUM!"))
            top = df.orderBy(F.desc("v") if largest else F.asc("v")).limit(n)
            found = top.agg((F.min if largest else F.max)("v")).scalar()
            return Val(found, "num", first_error(err, F.when(top.agg(F.count("v")).scalar() < n, F.lit("#NUM!"))))
        if b.base_row is None:
            raise FormulaError("a computed place of a scalar; give a number or fill it down")
        # k differs by row: every number has its place, met by an equi-join.
        place = F.floor(k.col).cast("bigint")
        name = at_place(b, df, df.agg(F.count(F.lit(1))).scalar() - place + 1 if largest else place)
        return Val(F.col(name), "num", first_error(err, k.err, F.when(F.col(name).isNull(), F.lit("#NUM!"))))

    return compile_


def at_place(b, df: DataFrame, place: Column) -> str:
    """Adds to the filled sheet the number that stands at a 1-based ascending place of df (v); NULL where there is none. Its column's name."""
    name, key, asked = b.new(), b.new(), b.new()
    placed = ordered.numbered(df, ["v"], key).withColumnRenamed("v", name)
    b.df = b.df.withColumn(asked, place).join(placed, F.col(asked) == F.col(key), "left").drop(key, asked)
    return name


function("LARGE", 2)(kth(True))
function("SMALL", 2)(kth(False))


@function("RANK", 2, 3)
def _rank(b, args):
    x = to_num(b.value(args[0]))
    order = 0 if len(args) < 3 else b.constant(args[2])
    if order is None:
        raise FormulaError("RANK's order must be a constant")
    if (arr := row_array(b, args[1:2])) is not None:
        known = x.col.isNotNull()
        better = F.size(F.filter(arr, lambda v: (v < x.col if order else v > x.col) & known)) + 1
        return Val(better.cast("double"), "num", first_error(x.err, F.when(~F.coalesce(F.array_contains(arr, x.col), F.lit(False)), F.lit("#N/A"))))
    df, err = stacked(b, args[1:2])
    if b.base_row is None:
        better = df.agg(F.count_if(F.col("v") < x.col if order else F.col("v") > x.col) + 1).scalar() if x.const is not None else None
        if better is None:
            raise FormulaError("RANK of a computed scalar; fill it down or give a number")
        there = df.agg(F.count_if(F.col("v") == x.col)).scalar()
        return Val(better, "num", first_error(x.err, err, F.when(there == 0, F.lit("#N/A"))))
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    name, key = b.new(), b.new()
    upto = ordered.running(counts, "v", {"upto": ("sum", F.col("n"))}, reverse=not order, bucket=ordered.quantile_bucket(counts, "v"))
    b.df = b.df.join(upto.select(F.col("v").alias(key), (F.col("upto") - F.col("n") + 1).alias(name)), x.col == F.col(key), "left").drop(key)
    return Val(F.col(name), "num", first_error(x.err, err, F.when(F.col(name).isNull(), F.lit("#N/A"))))


def at_share(b, args, share: Val, whole: float | None) -> Val:
    """The number at a share of the way, between its neighbours in order. whole: the share if it is a constant."""
    bad = F.lit("#NUM!")
    if whole is not None and not 0 <= whole <= 1:
        return Val(F.lit(None).cast("double"), "num", bad)
    if (arr := row_array(b, args[:1])) is not None:
        srt, p = F.sort_array(arr), share.col * (F.size(arr) - 1)
        low = F.get(srt, F.floor(p).cast("int"))
        out = low + (F.get(srt, F.ceil(p).cast("int")) - low) * (p - F.floor(p))
        ok = share.col.between(0, 1) & (F.size(arr) > 0)
        return Val(F.when(ok, out), "num", first_error(share.err, F.when(~ok, bad)))
    df, err = stacked(b, args[:1])
    if whole is not None:
        out = ordered.at_shares(df, "v", whole)
        return Val(out, "num", first_error(err, F.when(out.isNull(), bad)))
    if b.base_row is None:
        raise FormulaError("a computed share of a scalar; give a number or fill it down")
    n = df.agg(F.count(F.lit(1))).scalar()
    p = F.when(share.col.between(0, 1), share.col * (n - 1))
    low, high = at_place(b, df, F.floor(p) + 1), at_place(b, df, F.ceil(p) + 1)
    out = F.col(low) + (F.col(high) - F.col(low)) * (p - F.floor(p))
    return Val(out, "num", first_error(err, share.err, F.when(out.isNull(), bad)))


def as_constant(b, node: Node) -> float | None:
    got = b.constant(node)
    return float(got) if isinstance(got, int | float) else None


@function("PERCENTILE", 2)
def _percentile(b, args):
    return at_share(b, args, to_num(b.value(args[1])), as_constant(b, args[1]))


@function("QUARTILE", 2)
def _quartile(b, args):
    q = as_constant(b, args[1])
    quart = to_int(b.value(args[1]))
    return at_share(b, args, Val(quart.col / 4, "num", quart.err), None if q is None else int(q) / 4)
