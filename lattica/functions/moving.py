"""Ranges that a fill moves.

If both ends move, every row has a window of one height: its cells come into the row as an array, by a window of row numbers in the filled sheet itself or by a grouped copy of another sheet, and functions fold the array. If one end stays, the window grows row by row, and what can be added up becomes a running aggregate. Whatever has neither form is a FormulaError: a moving range is never taken as the fixed one that stands in the formula.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.parser import FormulaError, Unsupported
from lattica.plans import ordered
from lattica.refs import Range
from lattica.values import Val, numeric

#: Cells that one row's window may have.
MAX_WINDOW = 16_384


@dataclass
class Window:
    """A row's cells of ranges that move alike: an array of structs (at: 0-based place, and the cells), in row order. Rows that the sheet does not have are left out, or stand as empty cells if the window is padded."""

    col: Column
    cells: list[list[tuple[str, str, str | None]]]  # for each range and column: field, kind, field of the error
    height: int

    def val(self, x: Column, k: int = 0, j: int = 0) -> Val:
        """The cell of range k, column j in an element of the array."""
        name, kind, err = self.cells[k][j]
        return Val(x[name], kind, None if err is None else x[err])

    def each(self, f: Callable[[Column, int], Column], keep: Callable[[Column, int], Column] | None = None) -> Column:
        """f(element, column) of all cells, row by row, as one array; of those alone for which `keep` holds."""
        width = len(self.cells[0])
        if keep is None:
            made = F.transform(self.col, lambda x: F.array(*[f(x, j) for j in range(width)]))
            return F.flatten(made)
        if width == 1:
            return F.transform(F.filter(self.col, lambda x: keep(x, 0)), lambda x: f(x, 0))
        made = F.transform(self.col, lambda x: F.filter(F.array(*[F.struct(keep(x, j).alias("k"), f(x, j).alias("v")) for j in range(width)]), lambda y: y["k"]))
        return F.transform(F.flatten(made), lambda y: y["v"])


def moves(b, ranges: list[Range]) -> list[tuple[int | None, int | None] | None]:
    return [b.moving(r) for r in ranges]


def slides(b, ranges: list[Range]) -> bool:
    """Whether all ranges have both ends moving; False if none moves. A mixture, or one moving end, is neither."""
    found = moves(b, ranges)
    if all(m is None for m in found):
        return False
    if any(m is None or None in m for m in found):
        return False
    return True


def grows(b, ranges: list[Range]) -> bool:
    """Whether the ranges have one end that stays, in the same row for all, and end or begin in the row itself."""
    found = moves(b, ranges)
    if all(m is None for m in found):
        return False
    fixed = {(m, r.start.row if m and m[0] is None else r.end.row) for m, r in zip(found, ranges, strict=True)}
    m = found[0]
    return len(fixed) == 1 and m in ((None, 0), (0, None)) and all(b.own(r) for r in ranges)


def fields(sheet, rng: Range, k: int) -> tuple[list[Column], list[tuple[str, str, str | None]]]:
    cols, cells = [], []
    for j, c in enumerate(range(rng.start.col or 1, (rng.end.col or len(sheet.columns)) + 1)):
        v = sheet.val(c)
        err = f"e{k}_{j}" if v.err is not None else None
        cols.append(v.col.alias(f"c{k}_{j}"))
        if err:
            cols.append(v.err.alias(err))
        cells.append((f"c{k}_{j}", v.kind, err))
    return cols, cells


def window(b, ranges: list[Range], padded: bool = False) -> Window:
    """The cells of sliding ranges of one height and width."""
    if len({(r.height, r.width) for r in ranges}) > 1:
        raise FormulaError("ranges of different dimensions")
    height = ranges[0].height
    if height * ranges[0].width > MAX_WINDOW:
        raise Unsupported(f"a window of more than {MAX_WINDOW} cells in every row: {ranges[0]}")
    alike: dict[tuple[str, tuple], list[int]] = {}
    for k, r in enumerate(ranges):
        alike.setdefault((b.sheet_of(r).name, b.moving(r)), []).append(k)
    cells: list[list[tuple[str, str, str | None]]] = [[] for _ in ranges]
    parts = []
    for (_, (lo, hi)), which in alike.items():
        sheet = b.sheet_of(ranges[which[0]])
        cols = []
        for k in which:
            made, cells[k] = fields(sheet, ranges[k], k)
            cols += made
        parts.append(_collected(b, sheet, lo, hi, cols))
    if len(parts) == 1 and not padded:
        return Window(parts[0], cells, height)
    names = [[f for k in which for name, _, err in cells[k] for f in (name, err) if f] for which in alike.values()]
    # Windows of several offsets meet place by place; heights are a formula's, so a search of each place is short.
    at = lambda p, i: F.get(F.filter(p, lambda x: x["at"] == i), F.lit(0))
    whole = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.struct(i.cast("bigint").alias("at"), *[at(p, i)[f].alias(f) for p, fs in zip(parts, names, strict=True) for f in fs]))
    return Window(whole, cells, height)


def _collected(b, sheet, lo: int, hi: int, cols: list[Column]) -> Column:
    own = sheet is b.sheet
    if own and lo == hi == 0:
        return F.array(F.struct(F.lit(0).cast("bigint").alias("at"), *cols))
    row, name = b.sheet.numbered_row(b), b.new()
    if own:
        b.df = ordered.sliding(b.df, row, lo, hi, {name: F.collect_list(F.struct(F.col(row).cast("bigint").alias("at"), *cols))})
        found = F.col(name)
    else:
        other, key = sheet.numbered(), b.new()
        at = F.col(other.row).cast("bigint")
        copies = other.df.select(F.struct(at.alias("at"), *cols).alias("__c"), F.explode(F.sequence(at - hi, at - lo)).alias(key))
        each = copies.groupBy(key).agg(F.sort_array(F.collect_list("__c")).alias(name))
        b.df = b.df.join(each, F.col(row) == F.col(key), "left").drop(key)
        found = F.coalesce(F.col(name), F.array().cast(each.schema[name].dataType))
    first = F.col(row).cast("bigint") + lo
    return F.transform(found, lambda x: x.withField("at", x["at"] - first))


def numbers(b, ranges: list[Range], others: list[Column] = ()) -> Column:
    """All numbers of sliding ranges and single values, as one array."""
    parts = []
    for r in ranges:
        if b.own(r) and b.moving(r) != (0, 0) and r.height * r.width <= MAX_WINDOW:  # numbers alone, without places
            name, cells = b.new(), [numeric(b.sheet.val(c)) for c in range(r.start.col, r.end.col + 1)]
            b.df = ordered.sliding(b.df, b.sheet.numbered_row(b), *b.moving(r), {name: F.collect_list(cells[0] if len(cells) == 1 else F.array(*cells))})
            parts.append(F.col(name) if len(cells) == 1 else F.flatten(name))
            continue
        parts.append(_numbers_of(window(b, [r])))
    if others:
        parts.append(F.array(*others))
    return F.filter(reduce(F.concat, parts) if len(parts) > 1 else parts[0], lambda x: x.isNotNull())


def _numbers_of(w: Window) -> Column:
    return w.each(lambda x, j: numeric(w.val(x, 0, j)))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def in_reach(b, rng: Range) -> Column:
    """For a range with one end that stays: whether a row is at or beyond that end."""
    row = F.col(b.sheet.numbered_row(b))
    return row >= rng.start.row if b.moving(rng)[0] is None else rng.ends_after(row)
