"""Array formulas: expressions over ranges, cell by cell.

Ranges of an expression meet place by place. A range of one row or one column is repeated along the other axis; cells beyond a range of another size are #N/A. Aggregates fold the cells; at the top of a formula they are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import moving
from lattica.functions.registry import FUNCTIONS
from lattica.parser import Binary, Call, Name, Node, Unary, Unsupported
from lattica.refs import MAX_ROWS, Range, Ref
from lattica.values import Val, column_or_null, first_error

#: Besides the registered functions of values.
CELLWISE = {"IF", "IFS", "SWITCH", "CHOOSE", "NOT", "IFERROR", "IFNA", "ISERROR", "ISERR", "ISNA", "ISNUMBER", "ISTEXT", "ISBLANK", "N"}
PLACE = "__at"


def ranges(b, node: Node) -> dict[Node, Range]:
    """The ranges of several cells that an expression takes cell by cell, by how they are written; none for a range itself."""
    out: dict[Node, Range] = {}

    def walk(x: Node, inside: bool) -> None:
        if isinstance(x, Range | Name):
            rng = b.as_range(x) if inside else None
            if rng is not None and (rng.height > 1 or rng.width > 1):
                out[x] = rng
        elif isinstance(x, Unary):
            walk(x.arg, True)
        elif isinstance(x, Binary):
            walk(x.left, True)
            walk(x.right, True)
        elif isinstance(x, Call) and (x.name in CELLWISE or (x.name in FUNCTIONS and FUNCTIONS[x.name].elementwise)):
            for a in x.args:
                walk(a, True)

    walk(node, False)
    return out


def region(b, node: Node, numbers: bool = False) -> tuple[DataFrame, list[Val]] | None:
    """Rows of the expression's cells (with their 0-based place) and its columns; None if it has no ranges of several cells."""
    found = ranges(b, node)
    if not found:
        return None
    whole = list(dict.fromkeys(found.values()))
    height, width = max(r.height for r in whole), max(min(r.width, len(b.sheet_of(r).columns)) if not r.start.row else r.width for r in whole)
    spark = b.sheet.df.sparkSession
    df = None if height == MAX_ROWS else spark.range(height).select(F.col("id").alias(PLACE))
    cells: dict[Range, list[Val]] = {}
    for k, r in enumerate(whole):
        sheet = b.sheet_of(r).numbered()
        columns = range(r.start.col or 1, (r.start.col or 1) + min(r.width, width))
        if r.height == 1 and height > 1:
            cells[r] = [b.cell(Ref(c, r.start.row, True, True, r.sheet)) for c in columns]
            continue
        b.fixed(r)
        vals = [sheet.val(c) for c in columns]
        names = [(f"c{k}_{j}", f"e{k}_{j}" if v.err is not None else None) for j, v in enumerate(vals)]
        rows = sheet.df if not r.start.row else sheet.df.where(F.col(sheet.row).between(r.start.row, r.end.row))
        errs = [v.err.alias(e) for v, (_, e) in zip(vals, names, strict=True) if e]
        part = rows.select((F.col(sheet.row) - (r.start.row or 1)).cast("bigint").alias(PLACE), *[v.col.alias(n) for v, (n, _) in zip(vals, names, strict=True)], *errs)
        df = part if df is None else df.join(part, PLACE, "full_outer" if height == MAX_ROWS else "left")
        beyond = F.when(F.col(PLACE) >= r.height, F.lit("#N/A")) if r.height not in (1, height) else None
        cells[r] = [Val(F.col(n), v.kind, first_error(beyond, F.col(e) if e else None)) for v, (n, e) in zip(vals, names, strict=True)]
    none = Val(F.lit(None).cast("double"), "blank", F.lit("#N/A"))
    at = lambda vals, j: vals[0] if len(vals) == 1 else vals[j] if j < len(vals) else none
    return df, [b.in_array(node, {x: at(cells[r], j) for x, r in found.items()}, numbers) for j in range(width)]


def in_window(b, node: Node, f, numbers: bool = True):
    """For ranges that a fill moves: the array of f(value) over the expression's cells in each row's window. None if they do not move."""
    found = ranges(b, node)
    whole = list(dict.fromkeys(found.values()))
    if b.base_row is None or all(b.moving(r) is None for r in whole):
        return None
    if not moving.slides(b, whole):
        raise Unsupported(f"no form for an array formula over these ranges in a fill: {', '.join(map(str, whole))}")
    w = moving.window(b, whole, padded=True)
    return w.each(lambda x, j: f(b.in_array(node, {n: w.val(x, whole.index(r), j) for n, r in found.items()}, numbers)))


def spilled(b, node: Node) -> DataFrame:
    """The cells as rows: c1, c2, ... (and e1, e2, ... of error codes, where a cell can fail), _row from 1."""
    df, vals = region(b, node)
    out = []
    for j, v in enumerate(vals, 1):
        out.append(column_or_null(v).alias(f"c{j}"))
        if v.err is not None:
            out.append(v.err.alias(f"e{j}"))
    return df.select(*out, (F.col(PLACE) + 1).alias("_row"))
