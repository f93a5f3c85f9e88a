"""Mathematics and random numbers. Quotients are rounded to 12 places before floor and ceiling, so that decimal steps such as 0.1 behave as decimals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.registry import function, scalar
from lattica.values import HOST, Val, first_error, to_num


def num(col: Column, err: Column | None = None) -> Val:
    return Val(col, "num", err)


def checked(bad: Column, col: Column, code: str = "#NUM!") -> Val:
    return num(F.when(~bad, col), F.when(bad, F.lit(code)))


def near(x: Column) -> Column:
    return F.round(x, 12)


def scaled(x: Column, n: Column, step) -> Column:
    p = F.pow(F.lit(10.0), n)
    return F.signum(x) * step(near(F.abs(x) * p)) / p


scalar("ABS", "n")(lambda x: num(F.abs(x.col)))
scalar("SQRT", "n")(lambda x: checked(x.col < 0, F.sqrt(F.abs(x.col))))
scalar("ROUNDUP", "ni")(lambda x, n: num(scaled(x.col, n.col, F.ceil)))
scalar("ROUNDDOWN", "ni")(lambda x, n: num(scaled(x.col, n.col, F.floor)))
scalar("EXP", "n")(lambda x: num(F.exp(x.col)))
scalar("SIGN", "n")(lambda x: num(F.signum(x.col)))
scalar("INT", "n")(lambda x: num(F.floor(near(x.col)).cast("double")))
scalar("PI", "")(lambda: num(F.lit(math.pi)))
scalar("LN", "n")(lambda x: checked(x.col <= 0, F.log(F.greatest(x.col, F.lit(1e-300)))))
scalar("MOD", "nn")(lambda n, d: checked(d.col == 0, n.col - d.col * F.floor(near(F.try_divide(n.col, d.col))), "#DIV/0!"))
scalar("FLOOR", "nn")(lambda x, s: checked((s.col == 0) | (F.signum(x.col) * F.signum(s.col) < 0), F.floor(near(F.try_divide(x.col, s.col))) * s.col, HOST))
scalar("CEILING", "nn")(lambda x, s: checked((s.col == 0) | (F.signum(x.col) * F.signum(s.col) < 0), F.ceil(near(F.try_divide(x.col, s.col))) * s.col, HOST))


@scalar("ROUND", "ni")
def _round(x, n):
    p = F.pow(F.lit(10.0), n.col)
    return num(F.round(x.col, n.const) if isinstance(n.const, int) else F.signum(x.col) * F.floor(near(F.abs(x.col) * p) + 0.5) / p)


@scalar("TRUNC", "ni", 1)
def _trunc(x, n=None):
    return num(scaled(x.col, F.lit(0) if n is None else n.col, F.floor))


@scalar("POWER", "nn")
def _power(x, y):
    p = F.pow(x.col, y.col)
    bad = F.isnan(p) | (F.abs(p) == float("inf"))
    return checked(bad, p, HOST)


@scalar("LOG", "nn", 1)
def _log(x, base=None):
    b = F.lit(10.0) if base is None else base.col
    bad = (x.col <= 0) | (b <= 0)
    out = F.try_divide(F.log(F.greatest(x.col, F.lit(1e-300))), F.log(F.greatest(b, F.lit(1e-300)))) if base is not None else F.log10(F.greatest(x.col, F.lit(1e-300)))
    return num(F.when(~bad & (b != 1), out), F.when(bad, F.lit("#NUM!")).when(b == 1, F.lit("#DIV/0!")))


@scalar("MROUND", "nn")
def _mround(x, m):
    bad = F.signum(x.col) * F.signum(m.col) < 0
    return num(F.when(m.col == 0, 0.0).when(~bad, F.round(near(F.try_divide(x.col, m.col)), 0) * m.col), F.when(bad, F.lit(HOST)))


@function("RAND", 0)
def _rand(b, args):
    return num(F.rand(b.wb.seed))


@function("RANDBETWEEN", 2)
def _randbetween(b, args):
    lo, hi = (to_num(b.value(a)) for a in args)
    low, high = F.ceil(lo.col), F.floor(hi.col)
    bad = low > high
    return num(F.when(~bad, (F.floor(F.rand(b.wb.seed) * (high - low + 1)) + low).cast("double")), first_error(lo.err, hi.err, F.when(bad, F.lit("#NUM!"))))
