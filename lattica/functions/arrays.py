"""Functions whose result is a set of rows: DataFrames with _row, evaluated at the top of a formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.conditional import one_region
from lattica.functions.registry import FUNCTIONS, FunctionSpec
from lattica.parser import Call, FormulaError, Node, references
from lattica.plans import ordered
from lattica.refs import Range
from lattica.values import Val, kind_of, to_bool, to_text

MAX_CELLS = 1_048_576


def table(b, node: Node) -> tuple[DataFrame, list[str], str]:
    """An array argument as a DataFrame: its columns in order and its row column. Array functions nest."""
    if isinstance(node, Call) and node.name in ARRAYS:
        df = ARRAYS[node.name](b, node.args)
        return df, [c for c in df.columns if c != "_row"], "_row"
    rng = b.as_range(node)
    if rng is None:
        raise FormulaError("an array function takes a range")
    sheet = b.sheet_of(rng).numbered()
    region = b.region(rng)
    names = [sheet.columns[c - 1] for c in range(rng.start.col or 1, (rng.end.col or len(sheet.columns)) + 1) if sheet.has(c)]
    return region.df, names, sheet.row


def renumbered(df: DataFrame, names: list[str], row: str) -> DataFrame:
    return df.select(*[F.col(n) for n in names], F.col(row).alias("_row"))


def sort_keys(df: DataFrame, name: str) -> list:
    """Numbers before text (without case) before Booleans before the rest."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    return [c.isNull(), F.lower(c) if kind == "string" else c]


def sort_rows(b, args) -> DataFrame:
    """SORT: _row is the row's place in the sorted result. Descending is ascending reversed, ties too."""
    df, names, row = table(b, args[0])
    index = 1 if len(args) < 2 else int(b.constant(args[1]))
    down = len(args) > 2 and b.constant(args[2]) < 0
    if not 1 <= index <= len(names):
        raise FormulaError("SORT's index is outside the array")
    name = names[index - 1]
    ascending = [*sort_keys(df, name), F.col(row)]
    keys = [k.desc() if down else k.asc() for k in ascending]
    cut = df.withColumn("__b", ordered.cut_by(df, ascending))
    before = Window.orderBy(F.desc("__b") if down else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carry = cut.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = cut.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy(*keys))).join(F.broadcast(carry), F.col("__b") == F.col("__c"))
    return placed.select(*names, (F.col("__i") + F.col("__before")).cast("bigint").alias("_row"))


def unique_rows(b, args) -> DataFrame:
    """UNIQUE: the first row of each distinct row, text without case; exactly_once keeps singletons. _row is the row's own."""
    df, names, row = table(b, args[0])
    once = len(args) > 2 and bool(b.constant(args[2]))
    kinds = dict(df.dtypes)
    if len(args) > 1 and b.constant(args[1]):
        return unique_columns(df, names, row, once)
    keys = [(F.lower(n) if kinds[n] == "string" else F.col(n)).alias(f"__k{i}") for i, n in enumerate(names)]
    each = df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.col(row)).alias("__r"), F.min(row).alias("_row"), F.count(F.lit(1)).alias("__n"))
    if once:
        each = each.where("__n = 1")
    return each.select(*[F.col("__r")[n].alias(n) for n in names], "_row")


def unique_columns(df: DataFrame, names: list[str], row: str, once: bool) -> DataFrame:
    """The first of each group of equal columns. Columns are told apart by two hashes of all their cells; a row of them comes to the driver."""
    kinds = dict(df.dtypes)
    cell = lambda n: F.lower(n) if kinds[n] == "string" else F.col(n)
    prints = [F.struct(F.bit_xor(F.xxhash64(F.lit(k), F.col(row), F.lit(kinds[n]), cell(n), F.col(n).isNull()))).alias(f"h{i}_{k}") for i, n in enumerate(names) for k in range(2)]
    got = df.agg(*prints).first()
    of = [(got[2 * i][0], got[2 * i + 1][0], kinds[n]) for i, n in enumerate(names)]
    kept = [n for i, n in enumerate(names) if of.index(of[i]) == i and (not once or of.count(of[i]) == 1)]
    return renumbered(df, kept, row)


def filter_rows(b, args) -> DataFrame:
    """FILTER: rows whose include is TRUE or not zero; without any, if_empty or #N/A."""
    df, names, row = table(b, args[0])
    inside = list(dict.fromkeys(r for r in references(args[1]) if isinstance(r, Range)))
    rng = None if isinstance(args[0], Call) else b.as_range(args[0])
    if not inside:
        raise FormulaError("FILTER's include takes ranges")
    if rng is None or any(b.sheet_of(r) is not b.sheet_of(rng) or r.start.row != rng.start.row for r in inside):
        # Rows meet by their place in their ranges.
        for r in inside:
            b.sheet_of(r).numbered()
        other, vals = one_region(b, inside)
        place = F.col("__at") if "__at" in other.columns else F.col(b.sheet_of(inside[0]).row) - (inside[0].start.row or 1)
        include = to_bool(b.in_array(args[1], dict(zip(inside, vals, strict=True)))).col
        first = 1 if rng is None else rng.start.row or 1
        right = other.select((place + first).alias("__place"), include.alias("__in"))
        kept = df.join(right, F.col(row) == F.col("__place")).where("__in")
    else:
        kept = df.where(to_bool(b.in_array(args[1])).col)
    out = renumbered(kept, names, row)
    alt = b.value(args[2]) if len(args) > 2 else Val(F.lit("#N/A"), "text")
    one = df.sparkSession.range(1).select(*[(alt.col.try_cast(dict(out.dtypes)[n]) if i == 0 else F.lit(None).cast(dict(out.dtypes)[n])).alias(n) for i, n in enumerate(names)], F.lit(0).cast("bigint").alias("_row"))
    n = kept.agg(F.count(F.lit(1))).scalar()
    return out.unionByName(one.where(n == 0)) if len(args) > 2 else out


def sequence_rows(b, args) -> DataFrame:
    """SEQUENCE: a grid in row-major order."""
    got = [b.constant(a) for a in args]
    if any(x is None for x in got):
        raise FormulaError("SEQUENCE takes constants")
    rows, cols, start, step = (float(x) for x in (*got, *(1.0, 1.0, 1.0, 1.0)[len(got) :]))
    rows, cols = int(rows), int(cols)
    if rows < 1 or cols < 1 or rows * cols > MAX_CELLS:
        raise FormulaError("SEQUENCE needs at least one and at most 1,048,576 cells")
    df = b.sheet.df.sparkSession.range(rows)
    return df.select(*[(F.lit(start) + (F.col("id") * cols + j) * step).alias(f"c{j + 1}") for j in range(cols)], (F.col("id") + 1).alias("_row"))


def transposed(b, args) -> DataFrame:
    """TRANSPOSE: rows become columns c1, c2, ...; the source's rows are bounded by the width of the grid."""
    df, names, row = table(b, args[0])
    kinds = {dict(df.dtypes)[n] for n in names}
    cell = (lambda n: F.col(n)) if len(kinds) == 1 else (lambda n: F.when(F.col(n).isNotNull(), to_text(Val(F.col(n), kind_of(df.schema[n].dataType))).col))
    rng = b.as_range(args[0]) if not isinstance(args[0], Call) else None
    places = list(range(rng.start.row, rng.end.row + 1)) if rng is not None and rng.start.row else sorted(r[0] for r in df.select(row).limit(16_384 + 1).collect())
    if len(places) > 16_384:
        raise FormulaError("more rows than the grid has columns")
    stacked = df.select(F.col(row).alias("__r"), F.posexplode(F.array(*[cell(n) for n in names])).alias("__p", "__v"))
    out = stacked.groupBy("__p").pivot("__r", places).agg(F.first("__v"))
    return out.select(*[F.col(f"`{p}`").alias(f"c{i + 1}") for i, p in enumerate(places)], (F.col("__p") + 1).cast("bigint").alias("_row"))


ARRAYS = {"SORT": sort_rows, "UNIQUE": unique_rows, "FILTER": filter_rows, "SEQUENCE": sequence_rows, "TRANSPOSE": transposed}


def _nested(name: str):
    def compile_(b, args) -> Val:
        raise FormulaError(f"{name} gives rows; it stands at the top of a formula or inside an array function")

    return compile_


for _name, (_least, _most) in {"SORT": (1, 3), "UNIQUE": (1, 3), "FILTER": (2, 3), "SEQUENCE": (1, 4), "TRANSPOSE": (1, 1)}.items():
    FUNCTIONS[_name] = FunctionSpec(_name, _least, _most, _nested(_name))
