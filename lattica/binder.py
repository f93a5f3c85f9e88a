"""Binds formula trees to DataFrames.

Two frames: a scalar formula becomes one row over scalar subqueries (Catalyst merges those of one table into one scan); a filled-down formula becomes a column, where same-row references are columns, other rows windows, and criteria or lookups per row joins. Inside array arguments a range stands for its column, row by row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.parser import Binary, Call, ErrorLit, FormulaError, Logical, Name, Node, Num, Text, Unary, Unsupported, parse, rewrite
from lattica.plans import ordered
from lattica.refs import Range, Ref, parse_ref
from lattica.sheet import Sheet, Workbook
from lattica.values import Val, compare, error, first_error, literal, to_num, to_text

_NUMBERS = itertools.count()


@dataclass
class Region:
    """Cells of a range: rows of a DataFrame and its columns' values."""

    df: DataFrame
    vals: list[Val]
    sheet: Sheet
    range: Range


class Binder:
    def __init__(self, wb: Workbook, sheet: Sheet, base_row: int | None = None) -> None:
        self.wb, self.sheet, self.base_row = wb, sheet, base_row
        self.df = sheet.df
        self.arrays: bool | dict[Range, Val] = False
        self.numbers = False  # of branches of several kinds, only numbers count
        self.depth = 0

    # --- references -------------------------------------------------------

    def new(self) -> str:
        return f"__x{next(_NUMBERS)}"

    def sheet_of(self, ref: Ref | Range) -> Sheet:
        return self.wb.sheet(ref.sheet) if ref.sheet else self.sheet

    def own(self, ref: Ref | Range) -> bool:
        return self.sheet_of(ref) is self.sheet

    def as_range(self, node: Node) -> Range | None:
        """A range argument: literal, named, or by OFFSET and INDIRECT with constant arguments."""
        if isinstance(node, Ref):
            return Range(node, Ref(node.col, node.row, node.abs_col, node.abs_row))
        if isinstance(node, Range):
            return node
        if isinstance(node, Name):
            found = self.named(node)
            return self.as_range(found) if isinstance(found, Ref | Range | Name) else None
        if isinstance(node, Call) and node.name in ("OFFSET", "INDIRECT"):
            from lattica.functions.reference import resolve

            return resolve(self, node)
        return None

    def named(self, node: Name) -> Node | None:
        text = self.wb.name_text(node.name, self.sheet.name)
        if text is None:
            return None
        self.depth += 1
        if self.depth > 100:
            raise FormulaError(f"names refer to each other: {node.name}")
        return parse(text)

    def region(self, rng: Range) -> Region:
        """The whole range as a DataFrame, for anchors that do not move."""
        self.fixed(rng)
        sheet = self.sheet_of(rng)
        df = sheet.df
        cols = range(rng.start.col or 1, (rng.end.col or len(sheet.columns)) + 1)
        if rng.start.row:
            sheet.numbered()
            df = sheet.df.where(rng.covers(F.col(sheet.row)))
        used = [c for c in cols if sheet.has(c)] or [rng.start.col or 1]
        return Region(df, [sheet.val(c) for c in used], sheet, rng)

    def moving(self, rng: Range) -> tuple[int | None, int | None] | None:
        """Row offsets of a range that a fill moves, in its own sheet or another; None at an end that stays; None altogether if neither moves."""
        if self.base_row is None or not rng.start.row:
            return None
        lo = None if rng.start.abs_row else rng.start.row - self.base_row
        hi = None if rng.end.abs_row else rng.end.row - self.base_row
        return None if lo is None and hi is None else (lo, hi)

    def fixed(self, rng: Range) -> None:
        """A moving range where only one that stays can be read is an error, never the range as it stands."""
        if self.moving(rng) is not None:
            raise Unsupported(f"no form for a range that a fill moves like this: {rng}")

    def cell(self, ref: Ref) -> Val:
        sheet = self.sheet_of(ref)
        v = sheet.val(ref.col)
        if self.base_row is not None and self.own(ref) and not ref.abs_row:
            offset = ref.row - self.base_row
            if offset == 0:
                return v
            if v.kind == "blank":
                return v
            name = self.new()
            wanted = {name: F.max(v.col)}
            if v.err is not None:
                wanted[name + "e"] = F.max(v.err)
            self.df = ordered.sliding(self.df, self.sheet.numbered_row(self), offset, offset, wanted)
            return Val(F.col(name), v.kind, F.col(name + "e") if v.err is not None else None)
        if self.base_row is not None and not self.own(ref) and not ref.abs_row:
            other = sheet.numbered()
            at, name, key = self.sheet.numbered_row(self), self.new(), self.new()
            offset = ref.row - self.base_row
            right = other.df.select((F.col(other.row) - offset).alias(key), v.col.alias(name), *([v.err.alias(name + "e")] if v.err is not None else []))
            self.df = self.df.join(right, F.col(at) == F.col(key), "left").drop(key)
            return Val(F.col(name), v.kind, F.col(name + "e") if v.err is not None else None)
        if v.kind == "blank":
            return v
        sheet.numbered()
        one = sheet.df.where(F.col(sheet.row) == ref.row)
        err = None if v.err is None else one.agg(F.first(v.err)).scalar()
        return Val(one.agg(F.first(v.col)).scalar(), v.kind, err)

    # --- expressions ------------------------------------------------------

    def value(self, node: Node) -> Val:
        if isinstance(self.arrays, dict) and node in self.arrays:
            return self.arrays[node]
        match node:
            case Num(x) | Text(x) | Logical(x):
                return literal(x)
            case ErrorLit(c):
                return error(c)
            case Ref():
                return self.cell(node)
            case Range():
                if self.arrays is True and node.width == 1:
                    self.fixed(node)
                    return self.sheet_of(node).val(node.start.col)
                if node.width == 1 and node.start.row and node.start.row == node.end.row:
                    return self.cell(node.start)
                raise FormulaError(f"a range stands where a value belongs: {node}")
            case Name():
                found = self.named(node)
                return error("#NAME?") if found is None else self.value(found)
            case Unary("+", x):
                return self.value(x)
            case Unary("-", x):
                n = to_num(self.value(x))
                return Val(-n.col, "num", n.err, -n.const if isinstance(n.const, float) else None)
            case Unary("%", x):
                n = to_num(self.value(x))
                return Val(n.col / 100, "num", n.err)
            case Binary("&", a, b):
                x, y = to_text(self.value(a)), to_text(self.value(b))
                return Val(F.concat(x.col, y.col), "text", first_error(x.err, y.err))
            case Binary(op, a, b) if op in "+-*/^":
                return self.arithmetic(op, to_num(self.value(a)), to_num(self.value(b)))
            case Binary(op, a, b):
                return compare(op, self.value(a), self.value(b))
            case Call(name, args):
                from lattica.functions.registry import call

                return call(self, name, args)
        raise FormulaError(f"cannot evaluate {node}")

    @staticmethod
    def arithmetic(op: str, x: Val, y: Val) -> Val:
        err = first_error(x.err, y.err)
        if op == "/":
            zero = None if y.const not in (None, 0, 0.0) else F.when(y.col == 0, F.lit("#DIV/0!"))
            return Val(F.try_divide(x.col, y.col), "num", first_error(err, zero))
        if op == "^":
            p = F.pow(x.col, y.col)
            bad = F.isnan(p) | (F.abs(p) == float("inf"))
            return Val(F.when(~bad, p), "num", first_error(err, F.when(bad, F.lit("#NUM!"))))
        return Val({"+": lambda: x.col + y.col, "-": lambda: x.col - y.col, "*": lambda: x.col * y.col}[op](), "num", err)

    def constant(self, node: Node) -> object:
        """A literal argument's Python value, or None."""
        if isinstance(node, Num | Text | Logical):
            return node.value
        if isinstance(node, Unary) and isinstance(node.arg, Num) and node.op in "+-":
            return -node.arg.value if node.op == "-" else node.arg.value
        if isinstance(node, Name) and (found := self.named(node)) is not None:
            return self.constant(found)
        return None

    def over_one(self, one: DataFrame, build) -> list[Column]:
        """Expressions over the single column of a one-row table. Subqueries may not stand inside array functions, so a scalar formula computes them in the table and a filled one joins it."""
        name = self.new()
        one = one.toDF(name)
        if self.base_row is not None:
            self.df = self.df.crossJoin(F.broadcast(one))  # one row
            return build(F.col(name))
        made = one.select(*[c.alias(f"r{i}") for i, c in enumerate(build(F.col(name)))])
        return [made.select(c).scalar() for c in made.columns]

    def in_array(self, node: Node, cells: dict[Range, Val] | None = None, numbers: bool = False) -> Val:
        """The expression with ranges as columns, or as the given cells."""
        before = self.arrays, self.numbers
        self.arrays, self.numbers = True if cells is None else cells, numbers
        try:
            return self.value(node)
        finally:
            self.arrays, self.numbers = before


def substitute(node: Node, name: str, by: Node) -> Node:
    return rewrite(node, lambda x: by if isinstance(x, Name) and x.name.lower() == name.lower() else x)


def evaluate(wb: Workbook, formula: str, sheet: str) -> DataFrame:
    from lattica.functions import arrays, elementwise

    node = parse(formula)
    b = Binder(wb, wb.sheet(sheet))
    if isinstance(node, Call) and node.name in arrays.ARRAYS:
        return arrays.ARRAYS[node.name](b, node.args)
    if elementwise.ranges(b, node):
        return elementwise.spilled(b, node)
    v = b.value(node)
    err = F.lit(None).cast("string") if v.err is None else v.err
    shown = v.col if v.err is None else F.when(v.err.isNull(), v.col)
    return b.sheet.df.sparkSession.range(1).select(shown.alias("value"), err.alias("error"))


def fill_down(wb: Workbook, sheet: Sheet, formulas: dict[str, str], base_row: int, errors: bool) -> Sheet:
    b = Binder(wb, sheet, base_row)
    done = {name: b.value(parse(text)) for name, text in formulas.items()}
    stale = {sheet.errors[n] for n in done if n in sheet.errors}
    keep = [c for c in sheet.df.columns if c not in done and c not in stale]
    row = [] if sheet.row is None or sheet.row in keep else [sheet.row]
    out, err_names = [], {k: v for k, v in sheet.errors.items() if k not in done}
    for name, v in done.items():
        out.append((v.col if v.err is None else F.when(v.err.isNull(), v.col)).alias(name))
        if errors and v.err is not None:
            out.append(v.err.alias(f"{name}__err"))
            err_names[name] = f"{name}__err"
    df = b.df.select(*keep, *row, *out)
    columns = [*sheet.columns, *[n for n in done if n not in sheet.columns]]
    return sheet.with_df(df, columns, err_names)


def lit_range(text: str) -> Range:
    r = parse_ref(text)
    return r if isinstance(r, Range) else Range(r, r)
