"""Table operators over sheets: filter, select, sort, stats, bounds, search, view, diff, edits."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.parser import FormulaError, Node, parse, rewrite, show
from lattica.plans import ordered
from lattica.predicate import where
from lattica.refs import Range, Ref, col_number, parse_ref
from lattica.sheet import Sheet, Workbook
from lattica.values import numeric, serial, to_text


def selected(sheet: Sheet, spec: str | None) -> list[str]:
    """`A,C:E` or header names; letter ranges are inclusive."""
    if not spec:
        return list(sheet.columns)
    out = []
    for part in spec.split(","):
        a, colon, b = part.strip().partition(":")
        if colon:
            lo, hi = sorted((col_number(a), col_number(b)))
            out += [sheet.columns[i - 1] for i in range(lo, hi + 1) if sheet.has(i)]
        else:
            out.append(sheet.resolve(a))
    return out


def filter_sheet(sheet: Sheet, predicate: str, columns: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that match, in sheet order where the sheet has one and a limit asks for it."""
    df = sheet.df.where(where(sheet, predicate))
    keep = ([sheet.row] if sheet.row else []) + selected(sheet, columns)
    if limit is not None:
        df = (df.orderBy(sheet.row) if sheet.row else df).limit(limit)
    return df.select(*keep)


def sort_key(sheet: Sheet, name: str, numeric: bool) -> Column:
    """Booleans as 1 and 0, dates as serials, text lowered."""
    v = sheet.val(sheet.columns.index(name) + 1)
    c = F.lower(v.col) if v.kind == "text" else v.col.cast("int") if v.kind == "bool" else serial(v.col) if v.kind == "date" else v.col
    if numeric and v.kind == "text":
        c = F.trim(v.col).try_cast("double")
    return c


def sort_sheet(sheet: Sheet, keys: list[tuple[str, bool] | tuple[str, bool, bool]], place: str | None = None) -> DataFrame:
    """Stable multi-key sort; keys: (column, descending[, numeric]); blanks last ascending, first descending. place: instead of sorting, adds a column of that name with each row's place in the order, from 1."""
    order = [sort_key(sheet, sheet.resolve(k[0]), len(k) > 2 and bool(k[2])) for k in keys]
    down = [bool(k[1]) for k in keys]
    if sheet.row:
        order, down = [*order, F.col(sheet.row)], [*down, False]
    return sheet.df.orderBy(*ordered.directed(order, down)) if place is None else ordered.numbered(sheet.df, order, place, down=down)


def stats(sheet: Sheet, columns: str | None = None) -> DataFrame:
    """count, sum, min, max, mean of each column's numbers; dates and errors are skipped."""
    names = [n for n in selected(sheet, columns) if sheet.val(sheet.columns.index(n) + 1).kind == "num"]
    if not names:
        raise FormulaError("no numbers in range")
    one = [F.struct(F.lit(n).alias("column"), F.count(n).alias("count"), F.sum(F.col(n).cast("double")).alias("sum"), F.min(F.col(n).cast("double")).alias("min"), F.max(F.col(n).cast("double")).alias("max"), F.avg(n).alias("mean")) for n in names]
    return sheet.df.agg(F.array(*one).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def cell_array(sheet: Sheet) -> Column:
    """A row's cells in sheet order: _col, kind, num, txt, bool, ts, err, shown (NULL where empty)."""
    out = []
    for i, _ in enumerate(sheet.columns, 1):
        v = sheet.val(i)
        err = v.err if v.err is not None else F.lit(None).cast("string")
        none = lambda t: F.lit(None).cast(t)
        out.append(F.struct(
            F.lit(i).alias("_col"), F.when(err.isNotNull(), "error").otherwise(v.kind).alias("kind"),
            (v.col.cast("double") if v.kind == "num" else none("double")).alias("num"), (v.col if v.kind == "text" else none("string")).alias("txt"),
            (v.col if v.kind == "bool" else none("boolean")).alias("bool"), (v.col.cast("timestamp_ntz") if v.kind == "date" else none("timestamp_ntz")).alias("ts"),
            err.alias("err"), F.when(err.isNotNull(), err).otherwise(F.when(v.col.isNotNull(), to_text(v).col)).alias("shown"),
        ))
    return F.array(*out)


def cells(sheet: Sheet, pattern: str | None = None) -> DataFrame:
    """The long form: sheet, _row, _col, kind, num, txt, bool, ts, err, shown; empty cells are absent, and with a pattern all whose shown text it does not find. Cells are dropped before rows are taken apart."""
    sheet.numbered()
    keep = F.filter(cell_array(sheet), lambda c: c["shown"].isNotNull() if pattern is None else F.coalesce(c["shown"].rlike(pattern), F.lit(False)))
    return sheet.df.select(F.lit(sheet.name).alias("sheet"), F.col(sheet.row).alias("_row"), F.explode(keep).alias("c")).select("sheet", "_row", "c.*")


def cells_sorted(sheet: Sheet) -> DataFrame:
    """Cells row by row, left to right."""
    return cells(sheet).orderBy("_row", "_col")


def rows_sorted(sheet: Sheet) -> DataFrame:
    """Rows that have a cell, in order: _row and an array of their cells."""
    sheet.numbered()
    full = F.filter(cell_array(sheet), lambda c: c["shown"].isNotNull())
    return sheet.df.select(F.col(sheet.row).alias("_row"), full.alias("cells")).where(F.size("cells") > 0).orderBy("_row")


def columns_sorted(sheet: Sheet) -> DataFrame:
    """Cells column by column, top to bottom."""
    return cells(sheet).orderBy("_col", "_row")


def search(wb: Workbook, pattern: str, sheets: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Cells whose displayed text an unanchored regular expression finds."""
    every = [cells(wb.sheet(n), pattern) for n in sheets or [s.name for s in wb.sheets.values()]]
    hit = reduce(DataFrame.unionByName, every).select("sheet", "_row", "_col", F.col("shown").alias("value"))
    return hit.orderBy("sheet", "_row", "_col").limit(limit) if limit else hit


def bounds(sheet: Sheet) -> DataFrame:
    c = cells(sheet)
    return c.agg(F.min("_row").alias("min_row"), F.max("_row").alias("max_row"), F.min("_col").alias("min_col"), F.max("_col").alias("max_col"), F.count(F.lit(1)).alias("n_cells"))


def view(sheet: Sheet, text: str, skip_empty: bool = False) -> DataFrame:
    """A rectangle as wide rows; skip_empty leaves out rows without a cell in it."""
    r = parse_ref(text)
    rng = r if isinstance(r, Range) else Range(r, r)
    sheet.numbered()
    names = [sheet.columns[i - 1] for i in range(rng.start.col or 1, (rng.end.col or len(sheet.columns)) + 1) if sheet.has(i)]
    df = sheet.df.where(F.col(sheet.row).between(rng.start.row, rng.end.row)) if rng.start.row else sheet.df
    if skip_empty and names:
        df = df.where(reduce(lambda a, b: a | b, [F.col(f"`{n}`").isNotNull() for n in names]))
    return df.select(sheet.row, *[F.col(f"`{n}`") for n in names])


def diff(old: Sheet, new: Sheet) -> DataFrame:
    """_row, _col, status (added, removed, changed), before, after. Rows are joined, and only cells that differ are taken out of them."""
    light = lambda s, n: s.numbered().df.select(F.col(s.row).alias("_row"), F.transform(cell_array(s), lambda c: F.struct(F.when(c["shown"].isNotNull(), c["kind"]).alias("k"), c["shown"].alias("s"))).alias(n))
    both = light(old, "a").join(light(new, "b"), "_row", "full_outer")
    empty = F.array().cast("array<struct<k:string,s:string>>")
    pairs = F.zip_with(F.coalesce("a", empty), F.coalesce("b", empty), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    status = lambda x, y: F.when(x["k"].isNull() & y["k"].isNull(), None).when(x["k"].isNull(), "added").when(y["k"].isNull(), "removed").when((x["s"] != y["s"]) | (x["k"] != y["k"]), "changed")
    named = F.transform(pairs, lambda p, i: F.struct((i + 1).cast("int").alias("_col"), status(p["x"], p["y"]).alias("status"), p["x"]["s"].alias("before"), p["y"]["s"].alias("after")))
    return both.select("_row", F.explode(F.filter(named, lambda c: c["status"].isNotNull())).alias("c")).select("_row", "c.*")


def diff_workbooks(old: Workbook, new: Workbook) -> DataFrame:
    """sheet, status (added, removed, or that of a cell), _row, _col, before, after: sheets of one workbook alone are one row each."""
    spark = next(iter((old.sheets or new.sheets).values())).df.sparkSession
    ddl = "sheet string, status string, _row bigint, _col int, before string, after string"
    out = [spark.createDataFrame([(s.name, state, None, None, None, None) for a, b, state in ((old, new, "removed"), (new, old, "added")) for k, s in a.sheets.items() if k not in b.sheets], ddl)]
    for k, s in old.sheets.items():
        if k in new.sheets:
            out.append(diff(s, new.sheets[k]).select(F.lit(s.name).alias("sheet"), "status", F.col("_row").cast("bigint").alias("_row"), "_col", "before", "after"))
    return reduce(DataFrame.unionByName, out)


def append(sheet: Sheet, other: Sheet) -> Sheet:
    """other's rows below sheet's last row, by column position."""
    sheet.numbered()
    other.numbered()
    last = sheet.df.agg(F.coalesce(F.max(sheet.row), F.lit(0))).scalar()
    below = other.df.select((F.col(other.row) + last).alias(sheet.row), *[F.col(o).alias(n) for n, o in zip(sheet.columns, other.columns, strict=False)])
    return sheet.with_df(sheet.df.select(sheet.row, *sheet.columns).unionByName(below, allowMissingColumns=True))


def put(sheet: Sheet, patches: DataFrame, column: str) -> Sheet:
    """patches (_row, value): sets cells of a column; rows that were not there come in."""
    sheet.numbered()
    p = patches.select(F.col("_row").alias("__r"), F.col("value").alias("__v"), F.lit(True).alias("__in"))
    both = sheet.df.join(p, F.col(sheet.row) == F.col("__r"), "full_outer")
    out = both.select(*[F.coalesce(F.col(c), F.col("__r")).alias(c) if c == sheet.row else F.when(F.col("__in"), F.col("__v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in sheet.df.columns])
    return sheet.with_df(out)


def put_range(sheet: Sheet, text: str, values: list) -> Sheet:
    """Values into a rectangle, row by row and left to right; another number of values than cells is an error."""
    r = parse_ref(text)
    rng = r if isinstance(r, Range) else Range(r, r)
    if not rng.start.row or not rng.start.col or rng.end.col > len(sheet.columns):
        raise FormulaError(f"not a rectangle of {sheet.name}: {text}")
    if len(values) != rng.height * rng.width:
        raise FormulaError(f"{len(values)} values for {rng.height * rng.width} cells")
    for j in range(rng.width):
        name = sheet.columns[rng.start.col - 1 + j]
        kind = sheet.df.schema[name].dataType
        rows = [(rng.start.row + i, values[i * rng.width + j]) for i in range(rng.height)]
        patch = sheet.df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_row", T.LongType()), T.StructField("value", kind)]))
        sheet = put(sheet, patch, name)
    return sheet


def put_row(sheet: Sheet, row: int, start: int, values: list) -> Sheet:
    """Values into cells of a row, from a column on."""
    return put_range(sheet, str(Range(Ref(start, row), Ref(start + len(values) - 1, row))), values) if values else sheet


def put_column(sheet: Sheet, col: int, start: int, values: list) -> Sheet:
    """Values into cells of a column, from a row on."""
    return put_range(sheet, str(Range(Ref(col, start), Ref(col, start + len(values) - 1))), values) if values else sheet


def merge(sheet: Sheet, text: str) -> Sheet:
    """One cell of a rectangle: all but its first cell are emptied, and the sheet remembers the rectangle, which may not overlap another."""
    r = parse_ref(text)
    if not isinstance(r, Range) or not r.start.row or not r.start.col:
        raise FormulaError(f"not a rectangle: {text}")
    for other in map(parse_ref, sheet.merged):
        if other.start.row <= r.end.row and r.start.row <= other.end.row and other.start.col <= r.end.col and r.start.col <= other.end.col:
            raise FormulaError(f"{text} overlaps {other}")
    sheet.numbered()
    keep = sheet.columns[r.start.col - 1] if sheet.has(r.start.col) else None
    inside = F.col(sheet.row).between(r.start.row, r.end.row)
    cols = {sheet.columns[i - 1] for i in range(r.start.col, r.end.col + 1) if sheet.has(i)}
    gone = lambda c: inside & (F.col(sheet.row) != r.start.row) if c == keep else inside
    out = sheet.with_df(sheet.df.select(*[F.when(~gone(c), F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in sheet.df.columns]))
    out.merged = [*sheet.merged, str(r)]
    return out


def unmerge(sheet: Sheet, text: str) -> Sheet:
    out = sheet.with_df(sheet.df)
    out.merged = [x for x in sheet.merged if x != str(parse_ref(text))]
    return out


def auto_filter(sheet: Sheet, text: str | None) -> Sheet:
    """Sets the range of the sheet's filter, or takes it away: a state of the sheet, which hides nothing by itself."""
    out = sheet.with_df(sheet.df)
    out.filter_range = None if text is None else str(parse_ref(text))
    return out


def clear(sheet: Sheet, text: str) -> Sheet:
    """Empties a rectangle."""
    r = parse_ref(text)
    rng = r if isinstance(r, Range) else Range(r, r)
    sheet.numbered()
    inside = F.col(sheet.row).between(rng.start.row, rng.end.row) if rng.start.row else F.lit(True)
    cols = {sheet.columns[i - 1] for i in range(rng.start.col or 1, (rng.end.col or len(sheet.columns)) + 1) if sheet.has(i)}
    return sheet.with_df(sheet.df.select(*[F.when(~inside, F.col(c)).alias(c) if c in cols else F.col(c) for c in sheet.df.columns]))


def moved_ref(r: Ref, at: int, count: int, rows: bool, start: bool) -> Ref | None:
    """Where a cell goes when `count` rows (columns) come in at `at`, or -count go out; None if it is deleted."""
    n = r.row if rows else r.col
    if not n or n < at:
        return r
    if count < 0 and n < at - count:
        return None
    new = n + count
    return Ref(r.col, new, r.abs_col, r.abs_row, r.sheet) if rows else Ref(new, r.row, r.abs_col, r.abs_row, r.sheet)


def restructure(formula: str, at: int, count: int, rows: bool = True, sheet: str | None = None, own: str | None = None) -> str:
    """A formula's text after rows or columns of `sheet` were inserted (count > 0) or deleted (count < 0). Deleted references become #REF!, ranges that lose a part shrink. own: the sheet that holds the formula."""

    def one(x: Node) -> Node:
        from lattica.parser import ErrorLit

        if not isinstance(x, Ref | Range) or (sheet is not None and (x.sheet or own or sheet).lower() != sheet.lower()):
            return x
        if isinstance(x, Ref):
            return moved_ref(x, at, count, rows, True) or ErrorLit("#REF!")
        a, b = moved_ref(x.start, at, count, rows, True), moved_ref(x.end, at, count, rows, False)
        if a is None and b is None:
            return ErrorLit("#REF!")
        edge = lambda r, n: Ref(r.col, n, r.abs_col, r.abs_row, r.sheet) if rows else Ref(n, r.row, r.abs_col, r.abs_row, r.sheet)
        return Range(a or edge(x.start, at), b or edge(x.end, at - 1))

    return "=" + show(rewrite(parse(formula), one))


def insert_rows(sheet: Sheet, at: int, count: int) -> Sheet:
    sheet.numbered()
    return sheet.with_df(sheet.df.withColumn(sheet.row, F.when(F.col(sheet.row) >= at, F.col(sheet.row) + count).otherwise(F.col(sheet.row))))


def delete_rows(sheet: Sheet, at: int, count: int) -> Sheet:
    sheet.numbered()
    kept = sheet.df.where(~F.col(sheet.row).between(at, at + count - 1))
    return sheet.with_df(kept.withColumn(sheet.row, F.when(F.col(sheet.row) >= at + count, F.col(sheet.row) - count).otherwise(F.col(sheet.row))))


def insert_column(sheet: Sheet, at: int, name: str) -> Sheet:
    columns = [*sheet.columns[: at - 1], name, *sheet.columns[at - 1 :]]
    return sheet.with_df(sheet.df.withColumn(name, F.lit(None).cast("double")), columns)


def delete_column(sheet: Sheet, at: int) -> Sheet:
    name = sheet.columns[at - 1]
    return sheet.with_df(sheet.df.drop(name), [c for c in sheet.columns if c != name])


def tabulate(spark, rows: int, columns: dict[str, Column], name: str = "Sheet1") -> Sheet:
    """A sheet of computed cells; expressions read _row."""
    df = spark.range(1, rows + 1).withColumnRenamed("id", "_row")
    return Sheet(name, df.select("_row", *[c.alias(n) for n, c in columns.items()]), list(columns), "_row")


def fill_text(formula: str, rows: int, cols: int = 0) -> str:
    """The formula as a fill or copy by so many rows and columns writes it."""
    from lattica.parser import shift

    return "=" + show(shift(parse(formula), rows, cols))


BOUNDED = {
    "between": lambda c, a, b: c.between(a, b), "notBetween": lambda c, a, b: ~c.between(a, b), "equal": lambda c, a: c == a, "notEqual": lambda c, a: c != a,
    "greaterThan": lambda c, a: c > a, "lessThan": lambda c, a: c < a, "greaterThanOrEqual": lambda c, a: c >= a, "lessThanOrEqual": lambda c, a: c <= a,
}


def validate(sheet: Sheet, column: str, rule: str, *bounds_, kind: str = "decimal") -> Column:
    """A data-validation rule as a Boolean column; empty cells pass. rule: an operator of bounded rules, "list" (allowed values) or "any". kind of a bounded rule: decimal, whole (whole numbers alone), date, time (the fraction of a day) or textLength; a cell of another kind fails."""
    v = sheet.val(sheet.columns.index(sheet.resolve(column)) + 1)
    if rule == "any":
        return F.lit(True)
    if rule == "list":
        return F.coalesce(v.col.isin(*bounds_), F.lit(True))
    if rule not in BOUNDED or kind not in ("decimal", "whole", "date", "time", "textLength"):
        raise FormulaError(f"unknown rule {kind} {rule}")
    if kind == "textLength":
        return F.when(v.col.isNull(), True).otherwise(BOUNDED[rule](F.char_length(to_text(v).col), *bounds_))
    if v.kind not in ("num", "date"):
        return v.col.isNull()
    at = serial(v.col) if v.kind == "date" else v.col.cast("double")
    limits = [serial(F.lit(x)) if isinstance(x, datetime.date) else F.lit(float(x)) for x in bounds_]
    got = BOUNDED[rule](at - F.floor(at) if kind == "time" else at, *limits)
    return F.coalesce(got & (at == F.floor(at)) if kind == "whole" else got, F.lit(True))


def validate_custom(wb: Workbook, sheet: str, formula: str, column: str = "valid", base_row: int = 1) -> Sheet:
    """A custom rule: a formula filled down whose truth (an error is none) says whether the row passes."""
    from lattica.binder import fill_down

    return fill_down(wb, wb.sheet(sheet), {column: f"=IFERROR(IF({formula.lstrip('=')},TRUE,FALSE),FALSE)"}, base_row, False)


def conditional_format(wb: Workbook, sheet: str, column: str, rule: str, *given, out: str = "format") -> DataFrame:
    """What a conditional format says of each cell of a column, as a column beside the sheet: for the operators of bounded rules, "contains", "beginsWith", "expression" (a formula for the first row), "top" and "bottom" (the first n in rank) whether it applies; for "colorScale" and "dataBar" the place between the least number and the greatest, 0 to 1. Empty cells have none."""
    from lattica.binder import fill_down

    s = wb.sheet(sheet)
    name = s.resolve(column)
    v = s.val(s.columns.index(name) + 1)
    if rule == "expression":
        return fill_down(wb, s, {out: f"=IFERROR(IF({str(given[0]).lstrip('=')},TRUE,FALSE),FALSE)"}, 1, False).df
    if rule in BOUNDED:
        return s.df.withColumn(out, F.when(v.col.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(BOUNDED[rule](v.col, *given), F.lit(False))))
    if rule in ("contains", "beginsWith"):
        text = F.lower(to_text(v).col)
        return s.df.withColumn(out, F.when(v.col.isNotNull(), text.contains(given[0].lower()) if rule == "contains" else text.startswith(given[0].lower())))
    num = numeric(v)
    if rule in ("top", "bottom"):
        ranked = ordered.ranks(s.df.withColumn("__n", num), "__n", "__rank", rule == "top")
        return ranked.withColumn(out, F.when(F.col("__n").isNotNull(), F.col("__rank") <= int(given[0]))).drop("__n", "__rank")
    if rule in ("colorScale", "dataBar"):
        ends = s.df.agg(F.min(num).alias("__lo"), F.max(num).alias("__hi"))
        share = F.coalesce(F.try_divide(num - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.when(num.isNotNull(), F.lit(1.0)))
        return s.df.crossJoin(F.broadcast(ends)).withColumn(out, share).drop("__lo", "__hi")  # one row
    raise FormulaError(f"unknown rule {rule}")


def number_rows(df: DataFrame, order: list[str], row: str = "_row") -> DataFrame:
    return ordered.numbered(df, order, row)
