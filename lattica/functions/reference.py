"""References as values: positions, addresses, links, and ranges made at bind time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.registry import function
from lattica.parser import Call, FormulaError
from lattica.refs import MAX_COLS, MAX_ROWS, Range, Ref, col_letters, parse_ref
from lattica.values import Val, aligned, error, first_error, to_int, to_text

MAX_CELLS = 1_048_576


def num(x) -> Val:
    return Val(F.lit(float(x)), "num", None, float(x))


@function("ROW", 0, 1)
def _row(b, args):
    if args:
        rng = b.as_range(args[0])
        if rng is None:
            raise FormulaError("ROW takes a reference")
        if b.base_row is None or rng.start.abs_row or not b.own(rng):
            return num(rng.start.row or 1)
        return Val((F.col(b.sheet.numbered_row(b)) + (rng.start.row - b.base_row)).cast("double"), "num")
    if b.base_row is None:
        raise FormulaError("ROW() needs a current cell")
    return Val(F.col(b.sheet.numbered_row(b)).cast("double"), "num")


@function("COLUMN", 0, 1)
def _column(b, args):
    rng = b.as_range(args[0]) if args else None
    if rng is None:
        if args or b.base_row is None:
            raise FormulaError("COLUMN() needs a current cell")
        return num(len(b.sheet.columns) + 1)
    return num(rng.start.col or 1)


@function("ROWS", 1)
def _rows(b, args):
    rng = b.as_range(args[0])
    if rng is None:
        raise FormulaError("ROWS takes a range")
    return num(rng.height)


@function("COLUMNS", 1)
def _columns(b, args):
    rng = b.as_range(args[0])
    if rng is None:
        raise FormulaError("COLUMNS takes a range")
    return num(rng.width if rng.start.col else MAX_COLS)


def letters(n: Column) -> Column:
    """Column number to letters, up to three."""
    one = lambda k: F.char(k.cast("bigint") + 65)
    a, b2, c = (n - 1) % 26, F.floor((n - 1) / 26), F.floor((n - 27) / 676)
    two = F.concat(one((b2 - 1) % 26), one(a))
    return F.when(n <= 26, one(a)).when(n <= 702, two).otherwise(F.concat(one(c - 1), one((b2 - 1) % 26), one(a)))


@function("ADDRESS", 2, 5)
def _address(b, args):
    row, col = to_int(b.value(args[0])), to_int(b.value(args[1]))
    kind = int(b.constant(args[2])) if len(args) > 2 and b.constant(args[2]) is not None else 1
    a1 = b.constant(args[3]) if len(args) > 3 else True
    sheet = b.constant(args[4]) if len(args) > 4 else None
    if kind not in (1, 2, 3, 4):
        return Val(F.lit("#VALUE!"), "text")
    abs_row, abs_col = kind in (1, 2), kind in (1, 3)
    if a1 in (True, None, 1.0):
        out = F.concat(F.lit("$" * abs_col), letters(col.col), F.lit("$" * abs_row), row.col.cast("string"))
    else:
        part = lambda c, x, fixed: F.concat(F.lit(c if fixed else c + "["), x.cast("string"), F.lit("" if fixed else "]"))
        out = F.concat(part("R", row.col, abs_row), part("C", col.col, abs_col))
    if sheet:
        out = F.concat(F.lit(str(Ref(1, 1, sheet=str(sheet))).rsplit("!", 1)[0] + "!"), out)
    return Val(F.when((row.col < 1) | (col.col < 1), F.lit("#VALUE!")).otherwise(out), "text", first_error(row.err, col.err))


@function("CELL", 1, 2)
def _cell(b, args):
    info = str(b.constant(args[0]) or "").lower()
    rng = b.as_range(args[1]) if len(args) > 1 else None
    if info == "filename":
        return Val(F.lit(f"{b.wb.path.rpartition('/')[0]}/[{b.wb.path.rpartition('/')[2]}]{b.sheet.name}" if b.wb.path else ""), "text")
    if rng is None and b.base_row is None:
        return error("#VALUE!")
    if info == "row":
        return _row(b, args[1:])
    if info == "col":
        return _column(b, args[1:])
    if info == "address":
        at = rng.start if rng else None
        if at is not None and (b.base_row is None or at.abs_row):
            return Val(F.lit(f"${col_letters(at.col or 1)}${at.row or 1}"), "text")
        return Val(F.concat(F.lit(f"${col_letters(at.col if at else len(b.sheet.columns) + 1)}$"), _row(b, args[1:]).col.cast("bigint").cast("string")), "text")
    return error("#VALUE!")


@function("HYPERLINK", 1, 2)
def _hyperlink(b, args):
    return to_text(b.value(args[-1]))


class OutOfGrid(FormulaError):
    pass


def known(b, node) -> object:
    """An argument's Python value; None if it differs by row."""
    got = b.constant(node)
    if got is not None or b.base_row is not None:
        return got
    v = b.value(node)
    row = b.sheet.df.sparkSession.range(1).select(v.col.alias("v"), (F.lit(None).cast("string") if v.err is None else v.err).alias("e")).first()
    if row.e is not None:
        raise OutOfGrid(row.e)
    return row.v


def pointed(b, node: Call) -> Val:
    """OFFSET or INDIRECT to one cell whose address differs by row: rows and columns are computed, and the cells of the sheet, one row each, are met by them."""
    if node.name == "INDIRECT":
        if len(node.args) > 1:
            raise FormulaError("INDIRECT by row reads A1 references")
        t = to_text(b.value(node.args[0]))
        found = F.regexp_extract(t.col, r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$", 1), F.regexp_extract(t.col, r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$", 2)
        col = F.aggregate(F.split(F.upper(found[0]), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
        sheet, row, errs = b.sheet, found[1].try_cast("bigint"), [t.err]
    else:
        base = b.as_range(node.args[0])
        if base is None or len(node.args) > 3 or not base.start.row:
            raise FormulaError("OFFSET by row leads to one cell")
        rows, cols = (to_int(b.value(a)) for a in node.args[1:])
        sheet, errs = b.sheet_of(base), [rows.err, cols.err]
        own = F.lit(base.start.row) if base.start.abs_row else F.col(b.sheet.numbered_row(b)) + (base.start.row - b.base_row)
        row, col = own + rows.col, (F.lit(base.start.col) + cols.col).cast("int")
    at = b.sheet.numbered_row(b) if sheet is b.sheet else sheet.numbered().row
    vals = [sheet.val(c) for c in range(1, len(sheet.columns) + 1)]
    shown, kind = aligned(vals)
    none = F.lit(None).cast("string")
    cells = F.array(*[F.struct(c.alias("v"), (none if v.err is None else v.err).alias("e")) for c, v in zip(shown, vals, strict=True)])
    name, key, r, c = b.new(), b.new(), b.new(), b.new()
    b.df = b.df.withColumn(r, row.cast("bigint")).withColumn(c, col.cast("int"))
    b.df = b.df.join(sheet.df.select(F.col(at).cast("bigint").alias(key), cells.alias(name)), F.col(r) == F.col(key), "left").drop(key)
    hit = F.get(F.col(name), F.col(c) - 1)
    outside = F.when(F.col(r).isNull() | ~F.col(r).between(1, MAX_ROWS) | ~F.coalesce(F.col(c).between(1, MAX_COLS), F.lit(False)), F.lit("#REF!"))
    return Val(hit["v"], kind, first_error(*errs, outside, hit["e"]))


def resolve(b, node: Call) -> Range:
    """The range that OFFSET or INDIRECT names. In a formula that is not filled down, arguments that are no constants are computed first, one small job each."""
    given = [b.constant(a) if node.name == "OFFSET" and i == 0 else known(b, a) for i, a in enumerate(node.args)]
    if node.name == "INDIRECT":
        if not isinstance(given[0], str):
            raise FormulaError("INDIRECT's text must be a constant where a range is asked for")
        if len(given) > 1 and given[1] is False:
            raise FormulaError("INDIRECT reads A1 references")
        try:
            r = parse_ref(given[0])
        except ValueError:
            text = b.wb.name_text(given[0], b.sheet.name)
            if text is None:
                raise OutOfGrid("#REF!") from None
            r = parse_ref(text.lstrip("="))
        rng = r if isinstance(r, Range) else Range(r, r)
        fixed = lambda x: Ref(x.col, x.row, True, True, x.sheet)
        return Range(fixed(rng.start), fixed(rng.end))
    base = b.as_range(node.args[0])
    if base is None or any(x is None for x in given[1:]):
        raise FormulaError("OFFSET's arguments after the reference must be constants where a range is asked for")
    rows, cols = int(given[1]), int(given[2])
    height = int(given[3]) if len(given) > 3 else 1 if base.height == 1 or not base.start.row else base.height
    width = int(given[4]) if len(given) > 4 else 1 if base.width == 1 else base.width
    if len(given) < 4:
        height = width = 1
    r, c = base.start.row + rows, base.start.col + cols
    if height < 1 or width < 1 or r < 1 or c < 1 or r + height - 1 > MAX_ROWS or c + width - 1 > MAX_COLS:
        raise OutOfGrid("#REF!")
    fix = base.start.abs_row
    return Range(Ref(c, r, True, fix, base.sheet), Ref(c + width - 1, r + height - 1, True, fix, base.sheet))


def dynamic(name: str, least: int, most: int):
    @function(name, least, most)
    def _(b, args):
        if b.base_row is not None and any(b.constant(a) is None for a in args[1 if name == "OFFSET" else 0 :]):
            return pointed(b, Call(name, args))
        try:
            rng = resolve(b, Call(name, args))
        except OutOfGrid as e:
            base = b.as_range(args[0]) if name == "OFFSET" else None
            if b.base_row is not None and base is not None and not base.start.abs_row and len(args) == 3:
                return pointed(b, Call(name, args))  # outside in the first row, not in all
            return error(str(e) if str(e).startswith("#") else "#REF!")
        return b.value(rng.start if rng.height == 1 and rng.width == 1 else rng)


dynamic("OFFSET", 3, 5)
dynamic("INDIRECT", 1, 2)
