"""Compiled values: a Column, its static kind, and a column of error codes where it may fail.

Kinds: num, text, bool, date (date or timestamp column), blank (always empty). An empty cell is NULL of its column's kind. Errors are text codes; HOST stands for a failure that is not an error value: IFERROR catches it, IFNA does not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOST = "#HOST!"
MAX_SERIAL = 2_958_465


@dataclass
class Val:
    col: Column
    kind: str
    err: Column | None = None
    const: object = None  # the Python value of a literal

    def failing(self, err: Column | None) -> Val:
        return Val(self.col, self.kind, first_error(self.err, err), self.const)


def first_error(*errs: Column | None) -> Column | None:
    """The leftmost error, or None where nothing can fail."""
    real = [e for e in errs if e is not None]
    return None if not real else real[0] if len(real) == 1 else F.coalesce(*real)


def literal(x: object) -> Val:
    if x is None:
        return Val(F.lit(None).cast("double"), "blank")
    kind = "bool" if isinstance(x, bool) else "num" if isinstance(x, int | float) else "text"
    return Val(F.lit(float(x)) if kind == "num" else F.lit(x), kind, None, x)


def error(code: str) -> Val:
    return Val(F.lit(None).cast("double"), "blank", F.lit(code))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "date"
    if isinstance(t, T.NullType):
        return "blank"
    return "text"


def serial(d: Column) -> Column:
    """Days of the 1900 system, with its 29 February 1900."""
    at = d.cast("timestamp_ntz")
    day = F.unix_date(at.cast("date")) + 25569
    frac = (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) / F.lit(86400.0)
    return (day - F.when(day < 61, 1).otherwise(0)).cast("double") + frac


def from_serial(n: Column) -> Column:
    day = F.floor(n).cast("int")
    return F.date_from_unix_date(day + F.when(day < 60, 1).otherwise(0).cast("int") - 25569)


def plain(n: Column) -> Column:
    """A number as text without a needless fraction or exponent."""
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    exact = F.regexp_replace(n.cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    return F.when(whole, n.cast("decimal(20,0)").cast("string")).when(F.abs(n) < 1e15, exact).otherwise(n.cast("string"))


def parsed_number(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def to_num(v: Val) -> Val:
    if v.kind == "num":
        return Val(F.coalesce(v.col.cast("double"), F.lit(0.0)) if v.const is None else v.col, "num", v.err, v.const)
    if v.kind == "blank":
        return Val(F.lit(0.0), "num", v.err)
    if v.kind == "bool":
        return Val(F.coalesce(v.col.cast("double"), F.lit(0.0)), "num", v.err)
    if v.kind == "date":
        return Val(F.coalesce(serial(v.col), F.lit(0.0)), "num", v.err)
    n = parsed_number(v.col)
    return Val(F.coalesce(n, F.lit(0.0)), "num", first_error(v.err, F.when(v.col.isNotNull() & n.isNull(), F.lit("#VALUE!"))))


def to_int(v: Val) -> Val:
    n = to_num(v)
    return Val(F.when(n.col >= 0, F.floor(n.col)).otherwise(F.ceil(n.col)).cast("bigint"), "num", n.err, None if not isinstance(n.const, int | float) else int(n.const))


def to_text(v: Val) -> Val:
    if v.kind == "text":
        return Val(F.coalesce(v.col, F.lit("")) if v.const is None else v.col, "text", v.err, v.const)
    if v.kind == "blank":
        return Val(F.lit(""), "text", v.err)
    if v.kind == "bool":
        return Val(F.coalesce(F.when(v.col, "TRUE").when(~v.col, "FALSE"), F.lit("")), "text", v.err)
    if v.kind == "date":
        return Val(F.coalesce(F.date_format(v.col, "yyyy-MM-dd"), F.lit("")), "text", v.err)
    return Val(F.coalesce(plain(v.col.cast("double")), F.lit("")), "text", v.err)


def to_bool(v: Val) -> Val:
    if v.kind == "bool":
        return Val(F.coalesce(v.col, F.lit(False)), "bool", v.err, v.const)
    if v.kind == "text":
        up = F.upper(v.col)
        return Val(F.coalesce(up == "TRUE", F.lit(False)), "bool", first_error(v.err, F.when(v.col.isNotNull() & ~up.isin("TRUE", "FALSE"), F.lit("#VALUE!"))))
    n = to_num(v)
    return Val(n.col != 0, "bool", n.err)


def to_date(v: Val) -> Val:
    if v.kind == "date":
        return Val(F.coalesce(v.col.cast("date"), F.lit("1900-01-01").cast("date")), "date", v.err)
    n = to_num(v)
    ok = n.col.between(0, MAX_SERIAL)
    return Val(from_serial(F.when(ok, n.col).otherwise(F.lit(1.0))), "date", first_error(n.err, F.when(~ok, F.lit("#VALUE!"))))


def numeric(v: Val) -> Column:
    """What an aggregate takes from a range cell: numbers and dates; text and Booleans are skipped."""
    return v.col.cast("double") if v.kind == "num" else serial(v.col) if v.kind == "date" else F.lit(None).cast("double")


RANK = {"num": 0, "date": 0, "text": 1, "bool": 2}


def compare(op: str, a: Val, b: Val) -> Val:
    """Numbers before text before Booleans; text without case; empty equals 0, "" and FALSE."""
    err = first_error(a.err, b.err)
    if a.kind == "blank" and b.kind == "blank":
        return Val(F.lit(op in ("=", "<=", ">=")), "bool", err)
    ka, kb = (b.kind if a.kind == "blank" else a.kind), (a.kind if b.kind == "blank" else b.kind)
    ra, rb = RANK[ka], RANK[kb]
    ops = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    if ra == rb:
        same = {0: to_num, 1: to_text, 2: to_bool}[ra]
        x, y = same(a).col, same(b).col
        if ra == 1:
            x, y = F.lower(x), F.lower(y)
        if ra == 2:
            x, y = x.cast("int"), y.cast("int")
        return Val(ops[op](x, y), "bool", err)
    # Kinds differ, so order is by kind; an empty cell of a column takes the other's kind.
    empty = {0: 0.0, 1: "", 2: False}
    other = {0: to_num, 1: lambda v: Val(F.lower(to_text(v).col), "text"), 2: lambda v: Val(to_bool(v).col.cast("int"), "num")}
    by_kind = F.lit(ops[op](ra, rb)) if op != "=" else F.lit(False)
    if op == "<>":
        by_kind = F.lit(True)
    if_a_empty = ops[op](F.lit(int(empty[rb]) if rb == 2 else empty[rb]), other[rb](b).col)
    if_b_empty = ops[op](other[ra](a).col, F.lit(int(empty[ra]) if ra == 2 else empty[ra]))
    both = F.lit(op in ("=", "<=", ">="))
    return Val(F.when(a.col.isNull() & b.col.isNull(), both).when(a.col.isNull(), if_a_empty).when(b.col.isNull(), if_b_empty).otherwise(by_kind), "bool", err)


def common_kind(vals: list[Val]) -> str:
    kinds = {v.kind for v in vals} - {"blank"}
    return "blank" if not kinds else kinds.pop() if len(kinds) == 1 else "text"


def aligned(vals: list[Val]) -> tuple[list[Column], str]:
    """Columns of one type. Mixed kinds become text, as they are shown."""
    kind = common_kind(vals)
    if kind == "text":
        return [F.lit(None).cast("string") if v.kind == "blank" else v.col if v.kind == "text" else F.when(v.col.isNotNull(), to_text(v).col) for v in vals], kind
    cast = {"num": "double", "bool": "boolean", "date": "timestamp_ntz", "blank": "double"}[kind]
    return [F.lit(None).cast(cast) if v.kind == "blank" else v.col.cast(cast) for v in vals], kind


def bound(x: Column, f) -> Column:
    """f(x) with x computed once; an expression that names x often would otherwise hold as many copies of it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def conjunction(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def column_or_null(v: Val) -> Column:
    return v.col if v.err is None else F.when(v.err.isNull(), v.col)
