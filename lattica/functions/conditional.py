"""The SUMIF family and SUMPRODUCT.

Criteria that are constants filter the aggregate. A criterion that is a cell of the filled row, which would scan the range once per row, is rewritten: for equality the range is grouped by it once and joined, for a comparison (">"&A1) distinct numbers get running aggregates and an as-of join. Ranges that a fill moves are folded in each row's window, or become running aggregates where one end stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.criteria import group_key, loose_number, matches
from lattica.functions import moving
from lattica.functions.registry import function
from lattica.parser import Binary, FormulaError, Name, Node, Text, Unsupported, references
from lattica.plans import ordered
from lattica.refs import Range
from lattica.values import Val, aligned, common_kind, conjunction, first_error, numeric, serial, to_num


def one_region(b, nodes: list[Node]):
    """The rows on which positionally zipped ranges lie, and each range's value. Ranges of one sheet and the same rows need no join; others meet on their place."""
    ranges = [b.as_range(n) for n in nodes]
    if any(r is None for r in ranges):
        raise FormulaError("a range belongs here")
    if len({(r.height, r.width) for r in ranges}) > 1:
        raise FormulaError("ranges of different dimensions")
    regions = [b.region(r) for r in ranges]
    width = max(len(r.vals) for r in regions)
    if all(r.sheet is regions[0].sheet and x.start.row == ranges[0].start.row for r, x in zip(regions, ranges, strict=True)):
        df, vals = regions[0].df, [r.vals for r in regions]
    else:
        df, vals = None, []
        for k, (r, x) in enumerate(zip(regions, ranges, strict=True)):
            r.sheet.numbered()
            errs = [v.err.alias(f"e{k}_{j}") for j, v in enumerate(r.vals) if v.err is not None]
            part = r.df.select((F.col(r.sheet.row) - (x.start.row or 1)).alias("__at"), *[v.col.alias(f"c{k}_{j}") for j, v in enumerate(r.vals)], *errs)
            df = part if df is None else df.join(part, "__at", "full_outer")
            vals.append([Val(F.col(f"c{k}_{j}"), v.kind, F.col(f"e{k}_{j}") if v.err is not None else None) for j, v in enumerate(r.vals)])
    if width == 1:
        return df, [v[0] for v in vals]
    empty = Val(F.lit(None).cast("double"), "blank")
    vals = [[*v, *[empty] * (width - len(v))] for v in vals]  # beyond the used columns
    kinds = [common_kind(v) for v in vals]
    shown = [aligned(v)[0] for v in vals]
    if any(len({x.kind for x in v} - {"blank"}) > 1 for v in vals):
        raise Unsupported("a range of columns of several kinds")
    none = F.lit(None).cast("string")
    cells = [F.struct(*[c[j].alias(f"c{k}") for k, c in enumerate(shown)], *[(v[j].err if v[j].err is not None else none).alias(f"e{k}") for k, v in enumerate(vals)]) for j in range(width)]
    failing = [any(x.err is not None for x in v) for v in vals]
    df = df.select(F.explode(F.array(*cells)).alias("z")).select("z.*")
    return df, [Val(F.col(f"c{k}"), kinds[k], F.col(f"e{k}") if failing[k] else None) for k in range(len(vals))]


def criterion(b, node: Node) -> object:
    """A constant criterion's Python value; None if it differs by row."""
    got = b.constant(node)
    if got is not None:
        return got
    v = b.value(node)
    return v.const if v.const is not None else 0 if v.kind == "blank" else None


#: Criteria of the form operator & value of the row.
COMPARING = {"<": lambda a, x: a < x, "<=": lambda a, x: a <= x, ">": lambda a, x: a > x, ">=": lambda a, x: a >= x}


def row_criterion(b, node: Node) -> tuple[str, Val]:
    """A criterion that differs by row: its operator and what it compares with."""
    if isinstance(node, Binary) and node.op == "&" and isinstance(node.left, Text):
        op = node.left.value.strip()
        if op in ("=", "<>", *COMPARING):
            v = b.value(node.right)
            return op, v if op in ("=", "<>") else to_num(v)
        if op[:1] in "<>=":
            raise Unsupported(f"a criterion by row begins with an operator alone, or with none: {node}")
    return "=", b.value(node)


def meets(cell: Val, op: str, v: Val) -> Column:
    """Does the cell meet a criterion by row?"""
    if op in COMPARING:
        got = F.coalesce(COMPARING[op](loose_number(cell), v.col), F.lit(False))
    else:
        same = F.coalesce(group_key(cell) == F.coalesce(group_key(v), F.lit("n0.0")), F.lit(False))
        got = same if op == "=" else ~same
    return got if cell.err is None else got & cell.err.isNull()


MADE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def conditional(b, target: Node | None, pairs: list[tuple[Node, Node]], aggs: dict[str, str]) -> tuple[dict[str, Column], Column | None]:
    """Aggregates (name -> sum, count, min, max) of target over rows that meet all criteria; their columns and the error of matching cells."""
    nodes = ([target] if target is not None else []) + [r for r, _ in pairs]
    known = [criterion(b, c) for _, c in pairs]
    ranges = [b.as_range(n) for n in nodes]
    if any(r is None for r in ranges):
        raise FormulaError("a range belongs here")
    if moving.slides(b, ranges):
        return in_window(b, target is not None, ranges, known, pairs, aggs)
    if moving.grows(b, ranges):
        return growing(b, target is not None, ranges, known, pairs, aggs)
    df, vals = one_region(b, nodes)
    cell, tests = (vals[0] if target is not None else None), vals[1:] if target is not None else vals
    fixed, keyed, compared = [], [], []
    for v, k, (_, c) in zip(tests, known, pairs, strict=True):
        if k is not None:
            fixed.append(matches(v, k))
        else:
            op, x = row_criterion(b, c)
            (keyed if op == "=" else compared).append((v, op, x))
    ok = conjunction(fixed) if fixed else F.lit(True)
    num = numeric(cell) if cell is not None else F.lit(1)
    err = None if cell is None or cell.err is None else F.first(F.when(ok, cell.err), ignorenulls=True)
    if not keyed and not compared:
        out = {n: df.agg(MADE[how](F.when(ok, num))).scalar() for n, how in aggs.items()}
        return out, None if err is None else df.agg(err).scalar()
    if b.base_row is None:
        raise FormulaError("a criterion must be a constant unless the formula is filled down")
    if compared:
        if keyed or len(compared) > 1 or compared[0][1] == "<>":
            raise Unsupported("of criteria by row, one alone may compare, by <, <=, > or >=")
        return beyond(b, df.where(ok), cell, num, compared[0], aggs)
    keys = [group_key(v).alias(f"__k{i}") for i, (v, _, _) in enumerate(keyed)]
    names = {n: b.new() for n in aggs}
    grouped = df.where(ok).groupBy(*keys).agg(*[MADE[how](num).alias(names[n]) for n, how in aggs.items()], *([err.alias("__err")] if err is not None else []))
    ids = [b.new() for _ in keyed]
    for i, k in enumerate(ids):
        grouped = grouped.withColumnRenamed(f"__k{i}", k)
    e = None
    if err is not None:
        e = b.new()
        grouped = grouped.withColumnRenamed("__err", e)
    same = conjunction([F.coalesce(group_key(c), F.lit("n0.0")) == F.col(k) for (_, _, c), k in zip(keyed, ids, strict=True)])
    b.df = b.df.join(grouped, same, "left").drop(*ids)
    return {n: F.col(x) for n, x in names.items()}, None if e is None else F.col(e)


def beyond(b, df, cell: Val | None, num: Column, test: tuple[Val, str, Val], aggs: dict[str, str]) -> tuple[dict[str, Column], Column | None]:
    """Aggregates over the rows below or above a number of each row: running aggregates of the distinct numbers, met by an as-of join."""
    v, op, x = test
    up = op in (">", ">=")
    rows = df if cell is None or cell.err is None else df.where(cell.err.isNull())
    each = rows.select(loose_number(v).alias("__k"), num.alias("__v")).where("__k IS NOT NULL").groupBy("__k").agg(*[MADE[how]("__v").alias(n) for n, how in aggs.items()])
    bucket = ordered.quantile_bucket(each, "__k")
    summed = {f"__upto_{n}": ("sum" if how == "count" else how, F.col(n)) for n, how in aggs.items()}
    upto = ordered.running(each, "__k", summed, reverse=up, bucket=bucket, own_row=op in ("<=", ">="))
    name, asked = b.new(), b.new()
    strict = op in ("<", ">")
    # For < and >, what stands beyond a number that is itself in the table is what stands before it there.
    plain_, own = F.struct(*[ordered._joined("count" if how == "count" else how, F.col(f"__upto_{n}"), F.col(n)).alias(n) for n, how in aggs.items()]), F.struct(*[F.col(f"__upto_{n}").alias(n) for n in aggs])
    table = upto.select("__k", F.struct((plain_ if strict else own).alias("at"), own.alias("same"), F.col("__k").alias("k")).alias(name))
    b.df = ordered.asof(b.df.withColumn(asked, x.col), asked, table, "__k", [name], "__k", up, True, base=b.sheet.df, asked=x.col).drop(asked)
    got = F.when(F.col(name)["k"] == x.col, F.col(name)["same"]).otherwise(F.col(name)["at"])
    return {n: got[n] for n in aggs}, x.err


def in_window(b, has_target: bool, ranges: list, known: list, pairs: list[tuple[Node, Node]], aggs: dict[str, str]) -> tuple[dict[str, Column], Column | None]:
    """The same over ranges whose both ends a fill moves: each row folds its own window."""
    asked = [None if k is not None else row_criterion(b, c) for k, (_, c) in zip(known, pairs, strict=True)]
    w = moving.window(b, ranges, padded=True)
    first = int(has_target)

    def ok(x: Column, j: int) -> Column:
        cells = [w.val(x, i + first, j) for i in range(len(pairs))]
        return conjunction([matches(v, k) if a is None else meets(v, *a) for v, k, a in zip(cells, known, asked, strict=True)])

    def number(x: Column, j: int) -> Column:
        return numeric(w.val(x, 0, j)) if has_target else F.lit(1.0)

    def code(x: Column, j: int) -> Column:
        err = w.val(x, 0, j).err
        return F.lit(None).cast("string") if err is None else err

    nums = F.filter(w.each(number, ok), lambda v: v.isNotNull())
    made = {"sum": lambda: F.when(F.size(nums) > 0, moving.total(nums)), "count": lambda: F.size(nums).cast("bigint"), "min": lambda: F.array_min(nums), "max": lambda: F.array_max(nums)}
    failing = has_target and any(e for _, _, e in w.cells[0])
    errs = F.get(F.filter(w.each(code, ok), lambda e: e.isNotNull()), F.lit(0)) if failing else None
    return {n: made[how]() for n, how in aggs.items()}, errs


def growing(b, has_target: bool, ranges: list, known: list, pairs: list[tuple[Node, Node]], aggs: dict[str, str]) -> tuple[dict[str, Column], Column | None]:
    """The same over ranges of which one end stays: running aggregates, within a key if a criterion is a cell of the row."""
    if any(r.width > 1 for r in ranges):
        raise Unsupported("a conditional aggregate over several columns with one end that stays")
    vals = [b.sheet.val(r.start.col) for r in ranges]
    cell, tests = (vals[0] if has_target else None), vals[int(has_target) :]
    row, reverse = b.sheet.numbered_row(b), b.moving(ranges[0])[0] is not None
    ok = conjunction([moving.in_reach(b, ranges[0]), *[matches(v, k) for v, k in zip(tests, known, strict=True) if k is not None]])
    asked = [(v, row_criterion(b, c)) for v, k, (_, c) in zip(tests, known, pairs, strict=True) if k is None]
    if any(op != "=" for _, (op, _) in asked):
        raise Unsupported("a criterion by row that compares, over a range with one end that stays")
    num = numeric(cell) if cell is not None else F.lit(1)
    names = {n: b.new() for n in aggs}
    wanted = {names[n]: (how, F.when(ok, num)) for n, how in aggs.items()}
    e = None
    if cell is not None and cell.err is not None:
        e = b.new()
        wanted[e] = ("min", F.when(ok & cell.err.isNotNull(), F.struct(F.col(row).alias("r"), cell.err.alias("e"))))
    if asked:
        b.df = ordered.running_matched(b.df, row, [group_key(v) for v, _ in asked], [F.coalesce(group_key(x), F.lit("n0.0")) for _, (_, x) in asked], wanted, reverse, base=b.sheet.df)
    else:
        b.df = ordered.running(b.df, row, wanted, reverse, base=b.sheet.df)
    return {n: F.col(x) for n, x in names.items()}, None if e is None else F.col(e)["e"]


def paired(args: tuple[Node, ...]) -> list[tuple[Node, Node]]:
    if len(args) % 2:
        raise FormulaError("criteria ranges and criteria come in pairs")
    return [(args[i], args[i + 1]) for i in range(0, len(args), 2)]


def total(b, target, pairs) -> Val:
    got, err = conditional(b, target, pairs, {"s": "sum"})
    return Val(F.coalesce(got["s"], F.lit(0.0)), "num", err)


def mean(b, target, pairs) -> Val:
    got, err = conditional(b, target, pairs, {"s": "sum", "n": "count"})
    n = F.coalesce(got["n"], F.lit(0))
    return Val(F.try_divide(got["s"], n), "num", first_error(err, F.when(n == 0, F.lit("#DIV/0!"))))


@function("SUMIF", 2, 3)
def _sumif(b, args):
    return total(b, args[-1] if len(args) == 3 else args[0], [(args[0], args[1])])


@function("SUMIFS", 3, None)
def _sumifs(b, args):
    return total(b, args[0], paired(args[1:]))


@function("AVERAGEIF", 2, 3)
def _averageif(b, args):
    return mean(b, args[-1] if len(args) == 3 else args[0], [(args[0], args[1])])


@function("AVERAGEIFS", 3, None)
def _averageifs(b, args):
    return mean(b, args[0], paired(args[1:]))


def counted(b, pairs) -> Val:
    got, _ = conditional(b, None, pairs, {"n": "count"})
    return Val(F.coalesce(got["n"], F.lit(0)), "num")


@function("COUNTIF", 2)
def _countif(b, args):
    return counted(b, [(args[0], args[1])])


@function("COUNTIFS", 2, None)
def _countifs(b, args):
    return counted(b, paired(args))


for _name, _how in (("MAXIFS", "max"), ("MINIFS", "min")):

    @function(_name, 3, None)
    def _(b, args, _how=_how):
        got, err = conditional(b, args[0], paired(args[1:]), {"x": _how})
        return Val(F.coalesce(got["x"], F.lit(0.0)), "num", err)


def factor(v: Val) -> Column:
    """SUMPRODUCT's coercion: Booleans 1 and 0, dates serials, all else that is no number 0."""
    n = {"num": lambda: v.col.cast("double"), "bool": lambda: v.col.cast("double"), "date": lambda: serial(v.col)}.get(v.kind, lambda: F.lit(0.0))()
    return F.coalesce(n, F.lit(0.0))


@function("SUMPRODUCT", 1, None)
def _sumproduct(b, args):
    ranges = [r for a in args for r in references(a) if isinstance(r, Range)]
    ranges += [r for a in args if isinstance(a, Name) and (r := b.as_range(a)) is not None]
    if not ranges:
        vals = [b.value(a) for a in args]
        return Val(reduce(lambda x, y: x * y, map(factor, vals)), "num", first_error(*[v.err for v in vals]))
    if len({(r.height, r.width) for r in ranges}) > 1:
        return Val(F.lit(None).cast("double"), "num", F.lit("#VALUE!"))
    distinct = list(dict.fromkeys(ranges))
    times = lambda vals: reduce(lambda x, y: x * y, map(factor, vals))
    if moving.slides(b, distinct):
        w = moving.window(b, distinct, padded=True)
        row = lambda x, j: [b.in_array(a, {r: w.val(x, k, j) for k, r in enumerate(distinct)} | named(b, args, distinct, lambda k: w.val(x, k, j))) for a in args]
        none = F.lit(None).cast("string")
        code = lambda x, j: first_error(*[v.err for v in row(x, j)])
        errs = F.get(F.filter(w.each(lambda x, j: none if code(x, j) is None else code(x, j)), lambda e: e.isNotNull()), F.lit(0))
        return Val(moving.total(w.each(lambda x, j: times(row(x, j)))), "num", errs)
    if moving.grows(b, distinct):
        if ranges[0].width > 1:
            raise Unsupported("SUMPRODUCT over several columns with one end that stays")
        cells = {r: b.sheet.val(r.start.col) for r in distinct}
        vals = [b.in_array(a, cells) for a in args]
        row, name = b.sheet.numbered_row(b), b.new()
        e, err = b.new(), first_error(*[v.err for v in vals])
        reach = moving.in_reach(b, ranges[0])
        wanted = {name: ("sum", F.when(reach, times(vals)))}
        if err is not None:
            wanted[e] = ("min", F.when(reach & err.isNotNull(), F.struct(F.col(row).alias("r"), err.alias("e"))))
        b.df = ordered.running(b.df, row, wanted, b.moving(ranges[0])[0] is not None, base=b.sheet.df)
        return Val(F.coalesce(F.col(name), F.lit(0.0)), "num", None if err is None else F.col(e)["e"])
    if ranges[0].width > 1 or len({(b.sheet_of(r).name, r.start.row) for r in ranges}) > 1:
        df, vals = one_region(b, distinct)
        cells = dict(zip(distinct, vals, strict=True))
        vals = [b.in_array(a, cells | named(b, args, distinct, lambda k: vals[k])) for a in args]
    else:
        df, vals = b.region(ranges[0]).df, [b.in_array(a) for a in args]
    err = first_error(*[v.err for v in vals])
    out = df.agg(F.sum(times(vals))).scalar()
    return Val(F.coalesce(out, F.lit(0.0)), "num", None if err is None else df.agg(F.first(err, ignorenulls=True)).scalar())


def named(b, args, ranges: list, cell) -> dict:
    """Names among the arguments, by the ranges that they stand for."""
    return {a: cell(ranges.index(r)) for a in args if isinstance(a, Name) and (r := b.as_range(a)) in ranges}
