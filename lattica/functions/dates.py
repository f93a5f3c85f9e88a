"""Dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.registry import function, scalar
from lattica.parser import FormulaError
from lattica.values import HOST, Val, bound, first_error, to_date, to_int


def date(col: Column, err: Column | None = None) -> Val:
    return Val(col, "date", err)


def num(col: Column, err: Column | None = None) -> Val:
    return Val(col.cast("double"), "num", err)


@function("TODAY", 0)
def _today(b, args):
    return date(F.current_date() if b.wb.today is None else F.lit(b.wb.today).cast("date"))


@function("NOW", 0)
def _now(b, args):
    return date(F.current_timestamp() if b.wb.today is None else F.lit(b.wb.today).cast("timestamp_ntz"))


@scalar("DATE", "iii")
def _date(y, m, d):
    """No roll-over: a month or day out of range fails."""
    ok = y.col.between(1, 9999) & m.col.between(1, 12) & d.col.between(1, 31)
    first = F.make_date(F.when(ok, y.col).otherwise(2000).cast("int"), F.when(ok, m.col).otherwise(1).cast("int"), F.lit(1))
    ok = ok & (d.col <= F.dayofmonth(F.last_day(first)))
    return date(F.when(ok, F.date_add(first, (d.col - 1).cast("int"))), F.when(~ok, F.lit(HOST)))


scalar("YEAR", "d")(lambda d: num(F.year(d.col)))
scalar("MONTH", "d")(lambda d: num(F.month(d.col)))
scalar("DAY", "d")(lambda d: num(F.dayofmonth(d.col)))
scalar("EOMONTH", "di")(lambda d, n: date(F.last_day(F.add_months(d.col, n.col.cast("int")))))
scalar("EDATE", "di")(lambda d, n: date(F.add_months(d.col, n.col.cast("int"))))


def whole_months(a: Column, b: Column) -> Column:
    """Full months from a to b, towards zero as a calendar period."""
    raw = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return raw + F.when((raw > 0) & (F.dayofmonth(b) < F.dayofmonth(a)), -1).when((raw < 0) & (F.dayofmonth(b) > F.dayofmonth(a)), 1).otherwise(0)


@scalar("DATEDIF", "ddt")
def _datedif(a, b, unit):
    u = F.upper(unit.col)

    def units(x: Column, z: Column, months: Column) -> Column:
        years = F.when(months >= 0, F.floor(months / 12)).otherwise(F.ceil(months / 12))
        out = F.when(u == "Y", years).when(u == "M", months).when(u == "D", F.datediff(z, x)).when(u == "YM", months - years * 12)
        return out.when(u == "MD", F.datediff(z, F.add_months(x, months.cast("int")))).when(u == "YD", F.datediff(z, F.add_months(x, (years * 12).cast("int"))))

    out = bound(a.col, lambda x: bound(b.col, lambda z: bound(whole_months(x, z), lambda m: units(x, z, m))))
    return num(out, F.when(~u.isin("Y", "M", "D", "MD", "YM", "YD"), F.lit(HOST)))


def weekdays_upto(d: Column) -> Column:
    """Mondays to Fridays up to and with a date, counted from a Monday."""
    days = F.unix_date(d) + 4 - 1  # 1969-12-29 is a Monday
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)) + 1, F.lit(5))


def with_holidays(b, args, build) -> Column:
    """build(array of distinct weekday holidays), which a range or a value gives."""
    none = b.sheet.df.sparkSession.range(1)
    rng = b.as_range(args[2])
    if rng is None:
        return b.over_one(none.select(F.array(to_date(b.value(args[2])).col).alias("d")), lambda d: [build(d)])[0]
    region = b.region(rng)
    days = F.array_distinct(F.flatten(F.collect_list(F.array(*[F.when(v.col.isNotNull(), to_date(v).col) for v in region.vals]))))
    return b.over_one(region.df.agg(F.filter(days, lambda d: d.isNotNull() & (F.weekday(d) < 5)).alias("d")), lambda d: [build(d)])[0]


@function("NETWORKDAYS", 2, 3)
def _networkdays(b, args):
    a, z = to_date(b.value(args[0])), to_date(b.value(args[1]))

    def counted(days: Column | None) -> Column:
        def between(lo: Column, hi: Column) -> Column:
            n = weekdays_upto(hi) - weekdays_upto(F.date_sub(lo, 1))
            return n if days is None else n - F.size(F.filter(days, lambda d: d.between(lo, hi)))

        return bound(F.least(a.col, z.col), lambda lo: bound(F.greatest(a.col, z.col), lambda hi: between(lo, hi)))

    n = counted(None) if len(args) < 3 else with_holidays(b, args, counted)
    return num(F.when(a.col > z.col, -n).otherwise(n), first_error(a.err, z.err))


@function("WORKDAY", 2, 3)
def _workday(b, args):
    """The n-th working day after (before) a date: the first candidate by weekdays alone, moved on by the holidays passed until none is new."""
    a, n = to_date(b.value(args[0])), to_int(b.value(args[1]))

    def plain(a: Column, steps: Column) -> Column:
        """The date that many weekdays on; a start on a weekend counts from the nearest weekday behind it."""

        def walked(start: Column) -> Column:
            w, k = F.weekday(start), F.abs(steps)
            fwd = F.date_add(start, (F.floor(k / 5) * 7 + k % 5 + F.when(w + k % 5 > 4, 2).otherwise(0)).cast("int"))
            back = F.date_sub(start, (F.floor(k / 5) * 7 + k % 5 + F.when(w - k % 5 < 0, 2).otherwise(0)).cast("int"))
            return F.when(steps == 0, a).when(steps > 0, fwd).otherwise(back)

        wd = F.weekday(a)
        return bound(F.when(wd <= 4, a).when(steps >= 0, F.date_sub(a, (wd - 4).cast("int"))).otherwise(F.date_add(a, (7 - wd).cast("int"))), walked)

    def met(days: Column, a: Column, n: Column, to: Column) -> Column:
        return F.size(F.filter(days, lambda d: ((n > 0) & (d > a) & (d <= to)) | ((n < 0) & (d < a) & (d >= to))))

    def moved(days: Column, a: Column, n: Column) -> Column:
        # Every round adds the holidays that the last candidate passes; it stands once none is new, after one round per holiday at most.
        steps = F.aggregate(F.sequence(F.lit(0), F.size(days)), n, lambda s, _: n + F.signum(n).cast("bigint") * bound(plain(a, s), lambda to: met(days, a, n, to)))
        return bound(steps, lambda s: plain(a, s))

    err = first_error(a.err, n.err)
    if len(args) < 3:
        return date(bound(a.col, lambda x: bound(n.col, lambda k: plain(x, k))), err)
    return date(with_holidays(b, args, lambda days: bound(a.col, lambda x: bound(n.col, lambda k: moved(days, x, k)))), err)


def days360(a: Column, b: Column, us: bool) -> Column:
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    if us:
        feb_a = (F.month(a) == 2) & (a == F.last_day(a))
        feb_b = (F.month(b) == 2) & (b == F.last_day(b))
        d2 = F.when(feb_a & feb_b, 30).otherwise(d2)
        d1 = F.when(feb_a, 30).otherwise(d1)
        d2 = F.when((d2 == 31) & (d1 >= 30), 30).otherwise(d2)
        d1 = F.when(d1 == 31, 30).otherwise(d1)
    else:
        d1, d2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1


def leap(y: Column) -> Column:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


@function("YEARFRAC", 2, 3)
def _yearfrac(b, args):
    x, z = to_date(b.value(args[0])), to_date(b.value(args[1]))
    basis = 0 if len(args) < 3 else b.constant(args[2])
    if basis is None or int(basis) not in range(5):
        raise FormulaError("YEARFRAC's basis is a constant from 0 to 4")
    err = first_error(x.err, z.err)
    lo, hi = F.least(x.col, z.col), F.greatest(x.col, z.col)
    return num(bound(lo, lambda a: bound(hi, lambda c: year_share(a, c, int(basis)))), err)


def year_share(lo: Column, hi: Column, basis: int) -> Column:
    actual = F.datediff(hi, lo)
    if basis in (0, 4):
        return days360(lo, hi, basis == 0) / 360
    if basis in (2, 3):
        return actual / F.lit(360.0 if basis == 2 else 365.0)
    y1, y2 = F.year(lo), F.year(hi)
    feb29 = lambda y: F.make_date(y, F.lit(2), F.when(leap(y), 29).otherwise(28))
    within = (y1 == y2) | ((y2 == y1 + 1) & ((F.month(lo) > F.month(hi)) | ((F.month(lo) == F.month(hi)) & (F.dayofmonth(lo) >= F.dayofmonth(hi)))))
    holds = (leap(y1) & feb29(y1).between(lo, hi)) | (leap(y2) & feb29(y2).between(lo, hi))
    year = F.when((y1 == y2) & leap(y1), 366).when(holds & (y1 != y2), 366).otherwise(365)
    span = F.datediff(F.make_date(y2 + 1, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(1), F.lit(1))) / (y2 - y1 + 1)
    return F.when(within, actual / year).otherwise(actual / span)
