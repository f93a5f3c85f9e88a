"""Sheets and workbooks: DataFrames with sheet columns, and a catalog of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.parser import FormulaError
from lattica.plans import ordered
from lattica.refs import col_letters, col_number
from lattica.values import Val, kind_of


@dataclass
class Sheet:
    """A DataFrame as a sheet. columns: names in sheet order, A first. row: the column of 1-based row numbers; without one, rows are numbered by `order` when a formula needs positions. errors: column -> its column of error codes. merged, filter_range: merged rectangles and the range of the filter, which queries do not read."""

    name: str
    df: DataFrame
    columns: list[str] = field(default_factory=list)
    row: str | None = None
    order: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)
    merged: list[str] = field(default_factory=list)
    filter_range: str | None = None

    def __post_init__(self) -> None:
        if not self.columns:
            self.columns = [c for c in self.df.columns if c != self.row and c not in self.errors.values()]

    def numbered(self) -> Sheet:
        if self.row is None:
            if not self.order:
                raise FormulaError(f"sheet {self.name} has no row order, and positions are asked for")
            self.df, self.row = ordered.numbered(self.df, self.order), "_row"
        return self

    def numbered_row(self, binder) -> str:
        """The row column's name, also in the frame that a binder is building."""
        if self.row is None:
            extra = binder.df
            if not self.order:
                raise FormulaError(f"sheet {self.name} has no row order, and positions are asked for")
            self.df = ordered.numbered(self.df, self.order)
            binder.df = self.df if extra.columns == [c for c in self.df.columns if c != "_row"] else ordered.numbered(extra, self.order)
            self.row = "_row"
        return self.row

    def has(self, col: int) -> bool:
        return 1 <= col <= len(self.columns)

    def val(self, col: int) -> Val:
        """Column number -> its Val; outside the used columns every cell is empty."""
        if not self.has(col):
            return Val(F.lit(None).cast("double"), "blank")
        name = self.columns[col - 1]
        return Val(F.col(f"`{name}`"), kind_of(self.df.schema[name].dataType), F.col(f"`{self.errors[name]}`") if name in self.errors else None)

    def letter(self, name: str) -> str:
        return col_letters(self.columns.index(name) + 1)

    def resolve(self, name: str) -> str:
        """A header name in any case, else column letters."""
        for c in self.columns:
            if c.lower() == name.lower():
                return c
        if name.isalpha() and len(name) <= 3 and self.has(n := col_number(name)):
            return self.columns[n - 1]
        raise FormulaError(f"unknown column {name}")

    def with_df(self, df: DataFrame, columns: list[str] | None = None, errors: dict[str, str] | None = None) -> Sheet:
        return Sheet(self.name, df, columns or list(self.columns), self.row, self.order, dict(self.errors) if errors is None else errors, list(self.merged), self.filter_range)


@dataclass
class Workbook:
    """Sheets by name (any case), defined names (sheet scope before workbook scope), and what volatile functions read."""

    sheets: dict[str, Sheet] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    sheet_names: dict[tuple[str, str], str] = field(default_factory=dict)
    today: str | None = None
    seed: int = 0
    path: str = ""

    def add(self, sheet: Sheet) -> Sheet:
        self.sheets[sheet.name.lower()] = sheet
        return sheet

    def sheet(self, name: str) -> Sheet:
        try:
            return self.sheets[name.lower()]
        except KeyError:
            outside = name.startswith("[")
            raise FormulaError(f"{name} is of another workbook, and nothing is linked under that name" if outside else f"no sheet {name}") from None

    def link(self, book: str, sheet: Sheet) -> Sheet:
        """A sheet of another workbook, for references such as [book]Sheet1!A1. It is read as it is given here; the other workbook is never opened."""
        return self.add(Sheet(f"[{book}]{sheet.name}", sheet.df, list(sheet.columns), sheet.row, list(sheet.order), dict(sheet.errors)))

    def remove(self, name: str) -> None:
        del self.sheets[self.sheet(name).name.lower()]

    def rename(self, old: str, new: str) -> None:
        sheet = self.sheet(old)
        self.sheets = {(new.lower() if k == old.lower() else k): v for k, v in self.sheets.items()}
        sheet.name = new

    def copy(self, name: str, new: str) -> Sheet:
        s = self.sheet(name)
        return self.add(Sheet(new, s.df, list(s.columns), s.row, list(s.order), dict(s.errors), list(s.merged), s.filter_range))

    def define(self, name: str, text: str, sheet: str | None = None) -> None:
        if sheet is None:
            self.names[name.lower()] = text
        else:
            self.sheet_names[sheet.lower(), name.lower()] = text

    def name_text(self, name: str, sheet: str) -> str | None:
        return self.sheet_names.get((sheet.lower(), name.lower()), self.names.get(name.lower()))

    # Formulas; the binder is imported late because it reads sheets.

    def eval(self, formula: str, sheet: str | None = None) -> DataFrame:
        """A formula's result: one row (value, error), or for array functions a DataFrame with _row."""
        from lattica.binder import evaluate

        return evaluate(self, formula, sheet or next(iter(self.sheets.values())).name)

    def fill(self, sheet: str, column: str, formula: str, base_row: int = 1, errors: bool = False) -> Sheet:
        """Fills a formula, written as for base_row, down a whole column. errors: also keep <column>__err where the formula may fail."""
        from lattica.binder import fill_down

        return self.add(fill_down(self, self.sheet(sheet), {column: formula}, base_row, errors))

    def fill_all(self, sheet: str, formulas: dict[str, str], base_row: int = 1, errors: bool = False) -> Sheet:
        from lattica.binder import fill_down

        return self.add(fill_down(self, self.sheet(sheet), formulas, base_row, errors))
