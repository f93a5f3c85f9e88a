"""Lookups. A constant key becomes an aggregate over the table; a key per row becomes a join: equi-joins with the table deduplicated by the tie rule, or as-of joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.criteria import has_wildcard, wild
from lattica.functions import moving
from lattica.functions.registry import function
from lattica.parser import FormulaError, Unsupported
from lattica.plans import ordered
from lattica.refs import Range, Ref
from lattica.values import HOST, Val, aligned, first_error, literal, numeric, parsed_number, plain, serial, to_num


def strict_key(v: Val) -> Column:
    """Type-strict equality as equality of texts: text without case, dates as serials; NULL matches nothing."""
    if v.kind == "text":
        return F.concat(F.lit("t"), F.lower(v.col))
    if v.kind == "bool":
        return F.concat(F.lit("b"), v.col.cast("string"))
    if v.kind == "blank":
        return F.lit(None).cast("string")
    return F.concat(F.lit("n"), (serial(v.col) if v.kind == "date" else v.col.cast("double")).cast("string"))


def loose_key(v: Val) -> Column:
    """VLOOKUP's equality: numeric text matches numbers; Booleans match nothing."""
    if v.kind in ("bool", "blank"):
        return F.lit(None).cast("string")
    if v.kind == "text":
        n = parsed_number(v.col)
        return F.when(n.isNotNull(), F.lower(plain(n))).otherwise(F.lower(v.col))
    return F.lower(plain(serial(v.col) if v.kind == "date" else v.col.cast("double")))


def table_side(b, rng: Range, columns: list[int]):
    """Rows of a vertical range: place (0-based) and the asked columns' values."""
    b.fixed(rng)
    sheet = b.sheet_of(rng).numbered()
    first = rng.start.row or 1
    df = sheet.df if not rng.start.row else sheet.df.where(rng.covers(F.col(sheet.row)))
    return df, (F.col(sheet.row) - first).alias("__at"), [sheet.val(c) for c in columns]


def found(b, key: Val, rng_key: Range, col: int, result: Range | None, how: str, tie_last: bool, code: str, strict: bool = True) -> Val:
    """The value of column `col` (or the 1-based place, if result is None) at the matching row."""
    if b.moving(rng_key) is not None:
        return found_moving(b, key, rng_key, col, result, how, tie_last, code, strict)
    df, at, (k, v) = table_side(b, rng_key, [rng_key.start.col, col])
    if result is not None and (b.sheet_of(result) is not b.sheet_of(rng_key) or result.start.row != rng_key.start.row):
        other, there, (v,) = table_side(b, result, [col])
        right = other.select(there.alias("__there"), v.col.alias("__rv"), *([v.err.alias("__re")] if v.err is not None else []))
        df = df.select(at, k.col.alias("__rk")).join(right, F.col("__at") == F.col("__there"), "left")
        at, k, v = F.col("__at"), Val(F.col("__rk"), k.kind), Val(F.col("__rv"), v.kind, F.col("__re") if v.err is not None else None)
    value = v.col.alias("__v") if result is not None else F.lit(0).alias("__v")
    err = v.err if result is not None else None
    kind = v.kind if result is not None else "num"
    pick = F.max_by if tie_last else F.min_by
    name, flag, place = b.new(), b.new(), b.new()
    if how == "exact":
        make = strict_key if strict else loose_key
        table = df.select(make(k).alias("__k"), at, value, (F.lit(None).cast("string") if err is None else err).alias("__e")).where("__k IS NOT NULL")
        if key.const is not None or b.base_row is None:
            hit = table.where(F.col("__k") == make(key)) if key.const is not None else _correlated(b, table, key, make)
            one = hit.agg(pick(F.struct("__v", "__at", "__e"), "__at").alias("r"))
            got = one.select("r.__v").scalar() if result is not None else one.select(F.col("r.__at") + 1).scalar()
            miss = one.select(F.col("r").isNull()).scalar()
            return Val(got, kind, first_error(key.err, F.when(miss, F.lit(code)), None if err is None else one.select("r.__e").scalar()))
        each = table.groupBy("__k").agg(pick(F.struct("__v", "__at", "__e"), "__at").alias(name)).withColumnRenamed("__k", flag)
        b.df = b.df.join(each, make(key) == F.col(flag), "left").drop(flag)
    else:
        table = df.select(numeric(k).alias("__k"), at, value, (F.lit(None).cast("string") if err is None else err).alias("__e")).where("__k IS NOT NULL")
        number = to_num(key) if key.kind != "text" else Val(parsed_number(key.col), "num", key.err, float(key.const) if isinstance(key.const, int | float) else None)
        forward = how == "larger"
        if b.base_row is None:
            if number.const is None and not key.const:
                raise FormulaError("an approximate lookup of a computed scalar; give a constant or fill it down")
            hit = table.where(F.col("__k") >= number.col if forward else F.col("__k") <= number.col)
            order = F.struct((-F.col("__k") if forward else F.col("__k")).alias("k"), (F.col("__at") if tie_last else -F.col("__at")).alias("p"))
            one = hit.agg(F.max_by(F.struct("__v", "__at", "__e"), order).alias("r"))
            got = one.select("r.__v").scalar() if result is not None else one.select(F.col("r.__at") + 1).scalar()
            return Val(got, kind, first_error(key.err, F.when(one.select(F.col("r").isNull()).scalar(), F.lit(code))))
        asked = b.new()
        b.df = ordered.asof(b.df.withColumn(asked, number.col), asked, table.select("__k", "__at", F.struct("__v", "__at", "__e").alias(name)), "__k", [name], "__at", forward, tie_last, base=b.sheet.df, asked=number.col).drop(asked)
    got = F.col(name)["__v"] if result is not None else F.col(name)["__at"] + 1
    return Val(got, kind, first_error(key.err, F.when(F.col(name).isNull(), F.lit(code)), None if err is None else F.col(name)["__e"]))


def found_moving(b, key: Val, rng: Range, col: int, result: Range | None, how: str, tie_last: bool, code: str, strict: bool) -> Val:
    """The same in a range that a fill moves: each row searches its own window. Where one end stays, an exact first (or last) match of the whole column counts if the row's range holds it."""
    make = strict_key if strict else loose_key
    keys = Range(replace(rng.start, col=rng.start.col), replace(rng.end, col=rng.start.col))
    values = Range(replace(rng.start, col=col), replace(rng.end, col=col))
    if moving.slides(b, [rng]):
        w = moving.window(b, [keys, values])
        name = b.new()
        b.df = b.df.withColumn(name, w.col)
        cells = F.col(name)
        if how == "exact":
            fit = F.filter(cells, lambda x: make(w.val(x, 0)) == make(key))
            hit = F.element_at(F.when(F.size(fit) > 0, fit), -1 if tie_last else 1)
        else:
            number = to_num(key) if key.kind != "text" else Val(parsed_number(key.col), "num", key.err)
            ahead = (lambda k: k >= number.col) if how == "larger" else (lambda k: k <= number.col)
            fit = F.filter(cells, lambda x: ahead(numeric(w.val(x, 0))))
            nums = F.transform(fit, lambda x: numeric(w.val(x, 0)))
            best = F.array_min(nums) if how == "larger" else F.array_max(nums)
            fit = F.filter(fit, lambda x: numeric(w.val(x, 0)) == best)
            hit = F.element_at(F.when(F.size(fit) > 0, fit), -1 if tie_last else 1)
        v = w.val(hit, 1)
        got = (hit["at"] + 1).cast("double") if result is None else v.col
        return Val(got, "num" if result is None else v.kind, first_error(key.err, F.when(hit["at"].isNull(), F.lit(code)), None if result is None else v.err))
    move = b.moving(rng)
    if how != "exact" or not b.own(rng) or move not in ((None, 0), (0, None)) or tie_last != (move[0] is not None):
        raise Unsupported(f"no form for a lookup in a range that a fill moves like this: {rng}")
    row = b.sheet.numbered_row(b)
    k, v = b.sheet.val(rng.start.col), b.sheet.val(col)
    name, flag = b.new(), b.new()
    here = F.col(row) >= rng.start.row if move[0] is None else rng.ends_after(F.col(row))
    err = F.lit(None).cast("string") if v.err is None else v.err
    table = b.sheet.df.where(here).select(make(k).alias(flag), F.struct(F.col(row).alias("r"), v.col.alias("v"), err.alias("e")).alias("s")).where(F.col(flag).isNotNull())
    each = table.groupBy(flag).agg((F.max_by if tie_last else F.min_by)("s", F.col("s.r")).alias(name))
    b.df = b.df.join(each, make(key) == F.col(flag), "left").drop(flag)
    s = F.col(name)
    held = s["r"] <= F.col(row) if move[0] is None else s["r"] >= F.col(row)
    first = F.lit(rng.start.row) if move[0] is None else F.col(row)
    got = F.when(held, (s["r"] - first + 1).cast("double") if result is None else s["v"])
    miss = F.when(~F.coalesce(held, F.lit(False)), F.lit(code))
    return Val(got, "num" if result is None else v.kind, first_error(key.err, miss, None if result is None else s["e"]))


def _correlated(b, table, key: Val, make):
    """A scalar key that is itself a subquery joins as a one-row table."""
    one = b.sheet.df.sparkSession.range(1).select(make(key).alias("__want"))
    return table.join(one, F.col("__k") == F.col("__want"))


@function("VLOOKUP", 3, 4)
def _vlookup(b, args):
    key, rng, col = b.value(args[0]), b.as_range(args[1]), b.constant(args[2])
    approx = True if len(args) < 4 else b.constant(args[3])
    if rng is None or col is None or approx is None:
        raise FormulaError("VLOOKUP's table, column and range_lookup must be constants")
    if not 1 <= int(col) <= rng.width:
        return Val(F.lit(None).cast("double"), "blank", F.lit(HOST))
    return found(b, key, rng, rng.start.col + int(col) - 1, rng, "smaller" if approx else "exact", bool(approx), HOST, strict=False)


def across(b, keys: Range, values: Range | None, make):
    """Two rows of cells as an array of (k, v, at): a one-row table of it, or (for rows that a fill moves) a function that builds over the column; and the values' kind. Without values, v is the 1-based place."""
    place = lambda n: [F.lit(float(i + 1)) for i in range(n)]

    def zipped(ks: list[Column], vs: list[Column]) -> Column:
        return F.array(*[F.struct(k.alias("k"), v.alias("v"), F.lit(i).alias("at")) for i, (k, v) in enumerate(zip(ks, vs, strict=True))])

    ranges = [keys] if values is None else [keys, values]
    if moving.slides(b, ranges):
        w = [moving.window(b, [r], padded=True) for r in ranges]
        lines = [[x.val(F.get(x.col, F.lit(0)), 0, j) for j in range(len(x.cells[0]))] for x in w]
        vs, kind = (place(len(lines[0])), "num") if values is None else aligned(lines[1])
        name = b.new()
        b.df = b.df.withColumn(name, zipped([make(v) for v in lines[0]], vs))
        return None, lambda f: f(F.col(name)), kind
    parts, lines = [], []
    for n, r in zip("kv", ranges, strict=False):
        b.fixed(r)
        sheet = b.sheet_of(r).numbered()
        vals = [sheet.val(c) for c in range(r.start.col or 1, (r.end.col or len(sheet.columns)) + 1)]
        cols, kind = ([make(v) for v in vals], "num") if n == "k" else aligned(vals)
        lines.append([f"{n}{i}" for i in range(len(vals))])
        parts.append(sheet.df.where(F.col(sheet.row) == (r.start.row or 1)).agg(*[F.first(c).alias(x) for c, x in zip(cols, lines[-1], strict=True)]))
    one = parts[0] if values is None else parts[0].crossJoin(parts[1])  # one row each
    return one.select(zipped([F.col(x) for x in lines[0]], place(len(lines[0])) if values is None else [F.col(x) for x in lines[1]]).alias("p")), None, "num" if values is None else kind


def found_across(b, key: Val, keys: Range, values: Range | None, how: str, tie_last: bool, code: str) -> Val:
    """`found` in a row instead of a column."""
    pairs, build, kind = across(b, keys, values, strict_key if how == "exact" else numeric)
    want = strict_key(key) if how == "exact" else to_num(key).col

    def hit(cells: Column) -> list[Column]:
        fit = F.filter(cells, lambda p: p["k"] == want if how == "exact" else p["k"] >= want if how == "larger" else p["k"] <= want)
        if how != "exact":
            nums = F.transform(fit, lambda p: p["k"])
            best = F.array_min(nums) if how == "larger" else F.array_max(nums)
            fit = F.filter(fit, lambda p: p["k"] == best)
        got = F.element_at(F.when(F.size(fit) > 0, fit), -1 if tie_last else 1)
        return [got["v"], got["at"].isNull()]

    value, miss = build(hit) if pairs is None else b.over_one(pairs, hit)
    return Val(value, kind, first_error(key.err, F.when(miss, F.lit(code))))


@function("HLOOKUP", 3, 4)
def _hlookup(b, args):
    """Two rows of a bounded width, turned into key and value pairs."""
    key, rng, row = b.value(args[0]), b.as_range(args[1]), b.constant(args[2])
    approx = True if len(args) < 4 else b.constant(args[3])
    if rng is None or row is None or approx is None:
        raise FormulaError("HLOOKUP's table, row and range_lookup must be constants")
    if not 1 <= int(row) <= rng.height:
        return Val(F.lit(None).cast("double"), "blank", F.lit(HOST))
    line = Range(replace(rng.start, row=(rng.start.row or 1) + int(row) - 1), replace(rng.end, row=(rng.start.row or 1) + int(row) - 1))
    pairs, build, kind = across(b, Range(rng.start, replace(rng.end, row=rng.start.row)), line, numeric if approx else loose_key)
    want = to_num(key).col if approx else loose_key(key)

    def hit(pairs: Column) -> list[Column]:
        fit = F.filter(pairs, lambda p: p["k"] <= want if approx else p["k"] == want)
        if approx:
            best = F.array_max(F.transform(fit, lambda p: p["k"]))
            fit = F.filter(fit, lambda p: p["k"] == best)
        got = F.element_at(F.when(F.size(fit) > 0, fit), -1 if approx else 1)
        return [got["v"], got.isNull()]

    value, miss = build(hit) if pairs is None else b.over_one(pairs, hit)
    return Val(value, kind, first_error(key.err, F.when(miss, F.lit(HOST))))


@function("XLOOKUP", 3, 6)
def _xlookup(b, args):
    key, keys, results = b.value(args[0]), b.as_range(args[1]), b.as_range(args[2])
    mode = int(b.constant(args[4]) or 0) if len(args) > 4 else 0
    search = int(b.constant(args[5]) or 1) if len(args) > 5 else 1
    if keys is None or results is None or (keys.width, keys.height) != (results.width, results.height) or 1 not in (keys.width, keys.height):
        raise FormulaError("XLOOKUP takes two columns or two rows of one shape")
    backwards = search < 0
    row = keys.width > 1
    if mode == 2 and row:
        raise FormulaError("a wildcard lookup takes columns")
    if mode == 2:
        if b.sheet_of(keys) is not b.sheet_of(results) or keys.start.row != results.start.row:
            raise FormulaError("a wildcard lookup's columns lie side by side")
        if not isinstance(key.const, str):
            raise FormulaError("a wildcard lookup needs a constant pattern")
        df, at, (k, v) = table_side(b, keys, [keys.start.col, results.start.col])
        text = plain(k.col.cast("double")) if k.kind == "num" else k.col.cast("string")
        hit = df.select(at, v.col.alias("__v"), text.alias("__k")).where(wild(F.col("__k"), key.const) if has_wildcard(key.const) else F.lower("__k") == key.const.lower())
        one = hit.agg((F.max_by if backwards else F.min_by)(F.struct("__v"), "__at").alias("r"))
        out = Val(one.select("r.__v").scalar(), v.kind, F.when(one.select(F.col("r").isNull()).scalar(), F.lit("#N/A")))
    else:
        how = "exact" if mode == 0 else "smaller" if mode == -1 else "larger"
        last = not backwards if mode == -1 else backwards
        out = found_across(b, key, keys, results, how, last, "#N/A") if row else found(b, key, keys, results.start.col, results, how, last, "#N/A")
    if len(args) > 3:
        alt = b.value(args[3])
        cols, kind = aligned([out, alt])
        miss = out.err == "#N/A"
        none = F.lit(None).cast("string")
        return Val(F.when(miss, cols[1]).otherwise(cols[0]), kind, F.when(miss, alt.err if alt.err is not None else none).otherwise(out.err))
    return out


@function("MATCH", 2, 3)
def _match(b, args):
    key, rng = b.value(args[0]), b.as_range(args[1])
    mode = 1 if len(args) < 3 else b.constant(args[2])
    if rng is None or mode is None:
        raise FormulaError("MATCH's range and type must be constants")
    how = "exact" if mode == 0 else "smaller" if mode > 0 else "larger"
    if rng.width != 1:
        if rng.height != 1:
            raise FormulaError("MATCH takes one column or one row")
        return found_across(b, key, rng, None, how, False, HOST)
    out = found(b, key, rng, rng.start.col, None, how, False, HOST)
    return Val(out.col.cast("double"), "num", out.err)


@function("INDEX", 2, 3)
def _index(b, args):
    rng = b.as_range(args[0])
    if rng is None:
        raise FormulaError("INDEX takes a range")
    one_row = rng.start.row and rng.height == 1 and None not in (b.moving(rng) or ())  # as it stands; not the first of a growing range
    row, col = (args[1], args[2]) if len(args) == 3 else (None, args[1]) if one_row else (args[1], None)
    c = 1 if col is None else b.constant(col)
    if c is None:
        raise FormulaError("INDEX's column must be a constant")
    r = 1 if row is None else b.constant(row)
    wide = rng.end.col - rng.start.col + 1
    if not 1 <= int(c) <= wide or (r is not None and not 1 <= int(r) <= rng.height):
        return Val(F.lit(None).cast("double"), "blank", F.lit(HOST))
    if r is not None and b.moving(rng) is None:
        return b.cell(Ref(rng.start.col + int(c) - 1, (rng.start.row or 1) + int(r) - 1, True, True, rng.sheet))
    if r is not None and None not in b.moving(rng):  # the place moves with the range
        return b.cell(Ref(rng.start.col + int(c) - 1, rng.start.row + int(r) - 1, True, False, rng.sheet))
    place = to_num(b.value(row) if r is None else literal(float(r)))
    if b.moving(rng) is not None:
        return at_moving(b, rng, rng.start.col + int(c) - 1, place)
    # A row per row: the place is a key into the table.
    df, at, (v,) = table_side(b, rng, [rng.start.col + int(c) - 1])
    if b.base_row is None:
        one = b.sheet.df.sparkSession.range(1).select((F.floor(place.col) - 1).alias("__want"))
        got = df.select(at, v.col.alias("__v")).join(one, F.col("__at") == F.col("__want")).agg(F.first("__v")).scalar()
        return Val(got, v.kind, place.err)
    name, key = b.new(), b.new()
    b.df = b.df.join(df.select(at, v.col.alias(name)).withColumnRenamed("__at", key), F.floor(place.col) - 1 == F.col(key), "left").drop(key)
    return Val(F.col(name), v.kind, first_error(place.err, F.when(place.col < 1, F.lit(HOST))))


def at_moving(b, rng: Range, col: int, place: Val) -> Val:
    """The cell at a place of a range that a fill moves."""
    at = F.floor(place.col) - 1
    if moving.slides(b, [rng]):
        one = Range(replace(rng.start, col=col), replace(rng.end, col=col))
        w = moving.window(b, [one], padded=True)
        hit = F.get(w.col, at.cast("int"))
        v = w.val(hit)
        return Val(v.col, v.kind, first_error(place.err, F.when((at < 0) | (at >= rng.height), F.lit(HOST)), v.err))
    move = b.moving(rng)
    if move != (None, 0) or not b.own(rng):
        raise Unsupported(f"no form for INDEX in a range that a fill moves like this: {rng}")
    row, name, key = b.sheet.numbered_row(b), b.new(), b.new()
    v = b.sheet.val(col)
    wanted = at + rng.start.row
    found_ = b.sheet.df.select(F.col(row).alias(key), v.col.alias(name), *([v.err.alias(name + "e")] if v.err is not None else []))
    asked = b.new()
    b.df = b.df.withColumn(asked, wanted).join(found_, F.col(asked) == F.col(key), "left").drop(key, asked)
    out = F.when((at < 0) | (wanted > F.col(row)), F.lit(HOST))
    return Val(F.col(name), v.kind, first_error(place.err, out, F.col(name + "e") if v.err is not None else None))
