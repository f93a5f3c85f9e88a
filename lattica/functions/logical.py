"""Logic and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lattica.functions import elementwise, moving
from lattica.functions.registry import function
from lattica.parser import FormulaError, Name
from lattica.values import Val, aligned, compare, first_error, to_bool, to_int


def chosen(tests: list[Val], results: list[Val], code: str) -> Val:
    """The result of the first test that is TRUE, else the error. A branch's error counts only where the branch is taken, a test's where it is reached."""
    cols, kind = aligned(results)
    fallback = F.lit(code) if len(results) == len(tests) else results[-1].err if results[-1].err is not None else F.lit(None).cast("string")
    col = F.lit(None).cast("string" if kind == "text" else "boolean" if kind == "bool" else "timestamp_ntz" if kind == "date" else "double") if len(results) == len(tests) else cols[-1]
    err = fallback
    for t, r, c in reversed(list(zip(tests, results, cols, strict=False))):
        hit = F.coalesce(t.col, F.lit(False))
        col = F.when(hit, c).otherwise(col)
        err = F.when(hit, r.err if r.err is not None else F.lit(None).cast("string")).otherwise(err)
        if t.err is not None:
            err = F.when(t.err.isNotNull(), t.err).otherwise(err)
    can = len(results) == len(tests) or any(v.err is not None for v in (*tests, *results))
    return Val(col, kind, err if can else None)


def branches(b, nodes) -> list[Val]:
    """Values of branches; where only numbers count, text beside numbers is empty."""
    vals = [b.value(n) for n in nodes]
    if b.numbers and {"num", "date"} & {v.kind for v in vals}:
        vals = [Val(F.lit(None).cast("double"), "num", v.err) if v.kind in ("text", "bool") else v for v in vals]
    return vals


@function("IF", 3)
def _if(b, args):
    return chosen([to_bool(b.value(args[0]))], branches(b, args[1:]), "")


@function("IFS", 2, None)
def _ifs(b, args):
    if len(args) % 2:
        raise FormulaError("IFS takes pairs")
    return chosen([to_bool(b.value(a)) for a in args[::2]], branches(b, args[1::2]), "#N/A")


@function("SWITCH", 3, None)
def _switch(b, args):
    target, rest = b.value(args[0]), args[1:]
    n = len(rest) // 2
    tests = [compare("=", target, b.value(rest[2 * i])) for i in range(n)]
    results = [b.value(rest[2 * i + 1]) for i in range(n)]
    return chosen(tests, results + ([b.value(rest[-1])] if len(rest) % 2 else []), "#N/A")


@function("CHOOSE", 2, None)
def _choose(b, args):
    i = to_int(b.value(args[0]))
    tests = [Val(i.col == k, "bool", i.err) for k in range(1, len(args))]
    return chosen(tests, [b.value(a) for a in args[1:]], "#VALUE!")


def _flags(w):
    """Truth of the cells that are not empty."""
    return F.filter(w.each(lambda x, j: F.when(w.val(x, 0, j).col.isNotNull(), to_bool(w.val(x, 0, j)).col)), lambda x: x.isNotNull())


def every(name: str, join):
    @function(name, 1, None)
    def _(b, args):
        cols, errs = [], []
        for a in args:
            if not b.arrays and elementwise.ranges(b, a):
                df, vals = elementwise.region(b, a)
                fold = F.bool_and if name == "AND" else F.bool_or
                cols += [F.coalesce(df.agg(fold(to_bool(v).col)).scalar(), F.lit(name == "AND")) for v in vals]
                errs += [df.agg(F.first(v.err, ignorenulls=True)).scalar() for v in vals if v.err is not None]
                continue
            rng = b.as_range(a) if not (b.arrays and not isinstance(a, Name)) else None
            if rng is not None and (rng.height > 1 or rng.width > 1):
                if b.moving(rng) == (0, 0) and b.own(rng):
                    vals = [to_bool(b.sheet.val(c)) for c in range(rng.start.col, rng.end.col + 1)]
                    cols += [v.col for v in vals]
                    errs += [v.err for v in vals]
                    continue
                if moving.slides(b, [rng]):
                    w = moving.window(b, [rng])
                    flags = _flags(w)
                    cols.append(F.forall(flags, lambda x: x) if name == "AND" else F.exists(flags, lambda x: x))
                    continue
                region = b.region(rng)
                fold = F.bool_and if name == "AND" else F.bool_or
                cols += [F.coalesce(region.df.agg(fold(F.when(v.col.isNotNull(), to_bool(v).col))).scalar(), F.lit(name == "AND")) for v in region.vals]
                continue
            v = to_bool(b.value(a))
            cols.append(v.col)
            errs.append(v.err)
        return Val(reduce(join, cols), "bool", first_error(*errs))


every("AND", lambda a, b: a & b)
every("OR", lambda a, b: a | b)


@function("NOT", 1)
def _not(b, args):
    v = to_bool(b.value(args[0]))
    return Val(~v.col, "bool", v.err)


@function("LET", 3, None)
def _let(b, args):
    """Names are bound one after the other and seen by what follows them alone."""
    from lattica.binder import substitute

    if len(args) % 2 == 0:
        raise FormulaError("LET takes names with values and a body")
    rest = list(args)
    while len(rest) > 1:
        name, value, *rest = rest
        if not isinstance(name, Name):
            raise FormulaError("LET binds names")
        rest = [x if isinstance(x, Name) and i % 2 == 0 and i < len(rest) - 1 else substitute(x, name.name, value) for i, x in enumerate(rest)]
    return b.value(rest[0])
