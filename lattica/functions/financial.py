"""Financial functions. Newton's method runs as a fold inside the JVM, so no row leaves it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import moving
from lattica.functions.conditional import one_region
from lattica.functions.lookup import across
from lattica.functions.registry import function, scalar
from lattica.parser import FormulaError, Unsupported
from lattica.plans import ordered
from lattica.values import HOST, Val, first_error, numeric, to_num

FLAT = 1e-10


def num(col: Column, err: Column | None = None) -> Val:
    return Val(col, "num", err)


def finite(x: Column) -> Val:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return num(F.when(~bad, x), F.when(bad, F.lit(HOST)))


def opt(v: Val | None) -> Column:
    return F.lit(0.0) if v is None else v.col


def due(v: Val | None) -> Column:
    return F.when(opt(v) != 0, 1.0).otherwise(0.0)


@scalar("PMT", "nnnnn", 3)
def _pmt(r, n, pv, fv=None, kind=None):
    g = F.pow(1 + r.col, n.col)
    return finite(F.when(F.abs(r.col) < FLAT, -F.try_divide(pv.col + opt(fv), n.col)).otherwise(-F.try_divide(r.col * (pv.col * g + opt(fv)), (1 + r.col * due(kind)) * (g - 1))))


@scalar("FV", "nnnnn", 3)
def _fv(r, n, pmt, pv=None, kind=None):
    g = F.pow(1 + r.col, n.col)
    return finite(F.when(F.abs(r.col) < FLAT, -(opt(pv) + pmt.col * n.col)).otherwise(-(opt(pv) * g + pmt.col * (1 + r.col * due(kind)) * F.try_divide(g - 1, r.col))))


@scalar("PV", "nnnnn", 3)
def _pv(r, n, pmt, fv=None, kind=None):
    g = F.pow(1 + r.col, n.col)
    return finite(F.when(F.abs(r.col) < FLAT, -(opt(fv) + pmt.col * n.col)).otherwise(-F.try_divide(opt(fv) + pmt.col * (1 + r.col * due(kind)) * F.try_divide(g - 1, r.col), g)))


@scalar("NPER", "nnnnn", 3)
def _nper(r, pmt, pv, fv=None, kind=None):
    a = pmt.col * (1 + r.col * due(kind))
    ratio = F.try_divide(a - opt(fv) * r.col, a + pv.col * r.col)
    return finite(F.when(F.abs(r.col) < FLAT, -F.try_divide(pv.col + opt(fv), pmt.col)).otherwise(F.when(ratio > 0, F.try_divide(F.log(ratio), F.log(F.when(r.col > -1, 1 + r.col))))))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f reads it. Folds are interpreted, without common subexpressions."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def newton(guess: Column, f: Callable[[Column], Column], slope: Callable[[Column], Column], most: int, floor: float = 0.0) -> Column:
    """x with |f(x)| or the last step below 1e-7 within `most` steps, else NULL. Steps after the end cost a comparison alone."""
    start = F.struct(guess.alias("x"), F.lit(False).alias("done"), F.lit(False).alias("bad"))

    def step(s: Column, _: Column) -> Column:
        x = s["x"]

        def moved(nxt: Column, d: Column) -> Column:
            bad = F.coalesce(nxt.isNull() | F.isnan(nxt) | (F.abs(d) < floor) | (nxt <= -1), F.lit(True))
            return let(bad, lambda bad: F.struct(F.when(bad, x).otherwise(nxt).alias("x"), (~bad & (F.abs(nxt - x) < 1e-7)).alias("done"), bad.alias("bad")))

        return F.when(s["done"] | s["bad"], s).otherwise(let(slope(x), lambda d: let(x - F.try_divide(f(x), d), lambda nxt: moved(nxt, d))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: F.when(s["done"], s["x"]))


def root(b, x: Column) -> Val:
    """What `newton` gives, in a column of its own where a formula is filled down, so that value and error do not solve twice."""
    if b.base_row is not None and b.arrays is False:
        name = b.new()
        b.df, x = b.df.withColumn(name, x), F.col(name)
    return num(x, F.when(x.isNull(), F.lit("#NUM!")))


@scalar("RATE", "nnnnnn", 3, binder=True)
def _rate(b, n, pmt, pv, fv=None, kind=None, guess=None):
    t = due(kind)

    def f(r: Column) -> Column:
        power = lambda g: pv.col * g + pmt.col * (1 + r * t) * F.try_divide(g - 1, r) + opt(fv)
        return F.when(F.abs(r) < FLAT, pv.col + pmt.col * n.col + opt(fv)).otherwise(let(F.pow(1 + r, n.col), power))

    return root(b, newton(F.lit(0.1) if guess is None else guess.col, f, lambda r: (f(r + 1e-6) - f(r - 1e-6)) / 2e-6, 100))


def flows(b, node) -> Column | DataFrame:
    """A range's numbers, row by row and left to right, as one array: a series of payments, bounded by its nature. In every row for a range that a fill moves, else a one-row table."""
    rng = b.as_range(node)
    if rng is None:
        raise FormulaError("a range of payments belongs here")
    if moving.slides(b, [rng]):
        return moving.numbers(b, [rng])
    region = b.region(rng)
    region.sheet.numbered()
    df = region.df if rng.start.row else region.sheet.df
    cells = F.collect_list(F.struct(F.col(region.sheet.row).alias("r"), F.array(*map(numeric, region.vals)).alias("v")))
    return df.agg(F.filter(F.flatten(F.transform(F.array_sort(cells), lambda p: p["v"])), lambda x: x.isNotNull()).alias("xs"))


def solved(b, xs: Column | DataFrame, build: Callable[[Column], list[Column]]) -> list[Column]:
    """build over the array of payments, wherever it is."""
    if isinstance(xs, DataFrame):
        return b.over_one(xs, build)
    name = b.new()
    b.df = b.df.withColumn(name, xs)
    return build(F.col(name))


@function("NPV", 2)
def _npv(b, args):
    r = to_num(b.value(args[0]))
    rng = b.as_range(args[1])
    if rng is None:
        raise FormulaError("NPV takes a range")
    bad = F.when(r.col == -1, F.lit(HOST))
    safe = F.when(r.col == -1, 1.0).otherwise(1 + r.col)
    if moving.slides(b, [rng]):
        total = solved(b, flows(b, args[1]), lambda xs: [summed(xs, lambda x, i: x / F.pow(safe, i + 1))])[0]
        return num(total, first_error(r.err, bad))
    if moving.grows(b, [rng]) and rng.width == 1 and b.moving(rng)[0] is None:
        row, v = b.sheet.numbered_row(b), b.sheet.val(rng.start.col)
        n, name = b.new(), b.new()
        if r.const is None:
            raise Unsupported("NPV over a range with one end that stays takes a constant rate")
        x = F.when(moving.in_reach(b, rng), numeric(v))
        b.df = ordered.running(b.df, row, {n: ("count", x)}, base=b.sheet.df)
        b.df = ordered.running(b.df, row, {name: ("sum", x / F.pow(safe, F.col(n)))})
        return num(F.coalesce(F.col(name), F.lit(0.0)), first_error(r.err, bad))
    region = b.region(rng)
    region.sheet.numbered()
    df, width = region.df if rng.start.row else region.sheet.df, len(region.vals)
    at = F.col(region.sheet.row)
    if width == 1:
        df = df.select(at.cast("bigint").alias("__r"), numeric(region.vals[0]).alias("__v"))
    else:
        df = df.select(at.cast("bigint").alias("__at"), F.posexplode(F.array(*map(numeric, region.vals))).alias("__j", "__v")).select((F.col("__at") * width + F.col("__j")).alias("__r"), "__v")
    placed = ordered.running(df.where("__v IS NOT NULL"), "__r", {"__i": ("count", F.col("__v"))})
    if r.const is not None:
        total = placed.agg(F.sum(F.col("__v") / F.pow(safe, F.col("__i")))).scalar()
        return num(F.coalesce(total, F.lit(0.0)), first_error(r.err, bad))
    # A computed rate: payments by place, folded for each rate; a series is bounded by its nature.
    series = placed.agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda p: p["__v"]).alias("xs"))
    if b.base_row is None:
        raise FormulaError("NPV of a computed scalar rate; give a number or fill it down")
    return num(solved(b, series, lambda xs: [summed(xs, lambda x, i: x / F.pow(safe, i + 1))])[0], first_error(r.err, bad))


def summed(xs: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.transform(xs, lambda x, i: f(x, i.cast("double"))), F.lit(0.0), lambda a, x: a + x)


@function("IRR", 1, 2)
def _irr(b, args):
    guess = F.lit(0.1) if len(args) < 2 else to_num(b.value(args[1])).col

    def build(xs: Column) -> list[Column]:
        both = F.exists(xs, lambda x: x > 0) & F.exists(xs, lambda x: x < 0)
        out = root(b, newton(guess, lambda r: summed(xs, lambda x, i: x / F.pow(1 + r, i)), lambda r: summed(xs, lambda x, i: -i * x / F.pow(1 + r, i + 1)), 50))
        return [out.col, F.when(~F.coalesce(both, F.lit(False)), F.lit(HOST)).otherwise(out.err)]

    return num(*solved(b, flows(b, args[0]), build))


def dated(b, values, dates) -> Column | DataFrame:
    """Payments as an array of (value, years since the first), as `flows` has them."""
    ranges = [b.as_range(values), b.as_range(dates)]
    if any(r is None for r in ranges):
        raise FormulaError("ranges of payments and dates belong here")
    since = lambda rows: F.transform(rows, lambda p: F.struct(p["v"].alias("v"), ((p["d"] - F.get(rows, F.lit(0))["d"]) / 365).alias("t")))
    if moving.slides(b, ranges):
        w = moving.window(b, ranges, padded=True)
        pairs = w.each(lambda x, j: F.struct(numeric(w.val(x, 0, j)).alias("v"), numeric(w.val(x, 1, j)).alias("d")))
        name = b.new()
        b.df = b.df.withColumn(name, F.filter(pairs, lambda p: p["v"].isNotNull() & p["d"].isNotNull()))
        return since(F.col(name))
    sheet = b.sheet_of(ranges[0]).numbered()
    if ranges[0].width > 1:  # left to right in a row, then row by row
        cells = [b.region(r) for r in ranges]
        if cells[1].sheet is not sheet or ranges[1].start.row != ranges[0].start.row or len(cells[0].vals) != len(cells[1].vals):
            lines = [across(b, r, None, numeric)[0] for r in ranges] if all(r.height == 1 for r in ranges) else None
            if lines is None:
                raise FormulaError("payments and dates of several columns lie side by side")
            one = lines[0].select(F.col("p").alias("a")).crossJoin(lines[1].select(F.col("p").alias("z")))  # one row each
            rows = F.filter(F.zip_with("a", "z", lambda a, z: F.struct(a["k"].alias("v"), z["k"].alias("d"))), lambda p: p["v"].isNotNull() & p["d"].isNotNull())
            return one.select(rows.alias("q")).select(since(F.col("q")).alias("xs"))
        row = F.array(*[F.struct(numeric(v).alias("v"), numeric(d).alias("d")) for v, d in zip(cells[0].vals, cells[1].vals, strict=True)])
        all_ = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(sheet.row).alias("r"), row.alias("c")))), lambda p: p["c"]))
        one = cells[0].df.agg(F.filter(all_, lambda p: p["v"].isNotNull() & p["d"].isNotNull()).alias("q"))
        return one.select(since(F.col("q")).alias("xs"))
    df, (v, d) = one_region(b, [values, dates])
    place = F.col("__at") if "__at" in df.columns else F.col(sheet.row)
    rows = F.array_sort(F.collect_list(F.when(numeric(v).isNotNull() & numeric(d).isNotNull(), F.struct(place.alias("r"), numeric(v).alias("v"), numeric(d).alias("d")))))
    return df.agg(rows.alias("q")).select(since(F.col("q")).alias("xs"))


@function("XNPV", 3)
def _xnpv(b, args):
    r = to_num(b.value(args[0]))
    got = solved(b, dated(b, args[1], args[2]), lambda xs: [summed(xs, lambda p, _: p["v"] / F.pow(1 + r.col, p["t"]))])
    return num(got[0], r.err)


@function("XIRR", 2, 3)
def _xirr(b, args):
    guess = F.lit(0.1) if len(args) < 3 else to_num(b.value(args[2])).col

    def build(xs: Column) -> list[Column]:
        both = F.exists(xs, lambda p: p["v"] > 0) & F.exists(xs, lambda p: p["v"] < 0)
        out = root(b, newton(guess, lambda r: summed(xs, lambda p, _: p["v"] / F.pow(1 + r, p["t"])), lambda r: summed(xs, lambda p, _: -p["t"] * p["v"] / F.pow(1 + r, p["t"] + 1)), 100, 1e-10))
        return [out.col, F.when(~F.coalesce(both, F.lit(False)), F.lit(HOST)).otherwise(out.err)]

    return num(*solved(b, dated(b, args[0], args[1]), build))
