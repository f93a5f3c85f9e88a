"""A list of operations over a workbook, as one JSON text or Python list."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lattica.operators import table
from lattica.parser import FormulaError
from lattica.refs import Ref, parse_ref
from lattica.sheet import Sheet, Workbook


def put_value(wb: Workbook, sheet: Sheet, ref: str, value: object) -> Sheet:
    """One cell."""
    at = parse_ref(ref)
    if not isinstance(at, Ref) or not sheet.has(at.col):
        raise FormulaError(f"not a cell of {sheet.name}: {ref}")
    column = sheet.columns[at.col - 1]
    kind = sheet.df.schema[column].dataType
    patch = sheet.df.sparkSession.range(1).select(F.lit(at.row).cast("bigint").alias("_row"), F.lit(value).cast(kind).alias("value"))
    return table.put(sheet, patch, column)


def run(wb: Workbook, operations: str | list[dict]) -> Workbook:
    """Applies operations in order; each names its `op` and `sheet`. All are checked by name before the first runs."""
    ops = json.loads(operations) if isinstance(operations, str) else operations
    steps = {
        "put": lambda s, o: put_value(wb, s, o["ref"], o.get("value")),
        "clear": lambda s, o: table.clear(s, o["range"]),
        "fill": lambda s, o: wb.fill(s.name, o["column"], o["formula"], o.get("base_row", 1)),
        "insert_rows": lambda s, o: table.insert_rows(s, o["at"], o.get("count", 1)),
        "delete_rows": lambda s, o: table.delete_rows(s, o["at"], o.get("count", 1)),
        "insert_column": lambda s, o: table.insert_column(s, o["at"], o["name"]),
        "delete_column": lambda s, o: table.delete_column(s, o["at"]),
        "filter": lambda s, o: s.with_df(s.df.where(table.where(s, o["where"]))),
    }
    catalog = {"add_sheet": lambda o: wb.copy(o["from"], o["sheet"]), "remove_sheet": lambda o: wb.remove(o["sheet"]), "rename_sheet": lambda o: wb.rename(o["sheet"], o["to"]), "define_name": lambda o: wb.define(o["name"], o["text"], o.get("sheet"))}
    for o in ops:
        if o.get("op") not in steps and o.get("op") not in catalog:
            raise FormulaError(f"unknown operation {o.get('op')!r}")
    for o in ops:
        if o["op"] in catalog:
            catalog[o["op"]](o)
        else:
            wb.add(steps[o["op"]](wb.sheet(o["sheet"]), o))
    return wb
