"""Cell addresses: A1 references, ranges, anchors, sheet qualifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column

MAX_ROWS, MAX_COLS = 1_048_576, 16_384


def col_number(letters: str) -> int:
    """A -> 1."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def col_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@dataclass(frozen=True)
class Ref:
    """One cell. row 0 or col 0: the end of a full column or row range."""

    col: int
    row: int
    abs_col: bool = False
    abs_row: bool = False
    sheet: str | None = None

    def shifted(self, rows: int, cols: int = 0) -> Ref | None:
        """Moved as by a fill; None where it leaves the grid."""
        col = self.col if self.abs_col or not self.col else self.col + cols
        row = self.row if self.abs_row or not self.row else self.row + rows
        ok = (not self.col or 1 <= col <= MAX_COLS) and (not self.row or 1 <= row <= MAX_ROWS)
        return replace(self, col=col, row=row) if ok else None

    def __str__(self) -> str:
        name = "" if self.sheet is None else (self.sheet if re.fullmatch(r"[A-Za-z_]\w*", self.sheet) else "'" + self.sheet.replace("'", "''") + "'") + "!"
        return name + ("$" * self.abs_col + col_letters(self.col) if self.col else "") + ("$" * self.abs_row + str(self.row) if self.row else "")


@dataclass(frozen=True)
class Range:
    """An inclusive rectangle; full columns have rows 0, full rows columns 0."""

    start: Ref
    end: Ref

    @property
    def sheet(self) -> str | None:
        return self.start.sheet

    @property
    def width(self) -> int:
        return self.end.col - self.start.col + 1

    @property
    def height(self) -> int:
        return self.end.row - self.start.row + 1 if self.start.row else MAX_ROWS

    @property
    def to_end(self) -> bool:
        """Whether it ends in the grid's last row; a table may have more rows, and all of them are meant."""
        return self.end.row == MAX_ROWS

    def covers(self, row: Column) -> Column:
        """Whether a row number lies in the range's rows."""
        return row >= self.start.row if self.to_end else row.between(self.start.row, self.end.row)

    def ends_after(self, row: Column) -> Column:
        """Whether a row number is at or before the last row."""
        return row.isNotNull() if self.to_end else row <= self.end.row

    def shifted(self, rows: int, cols: int = 0) -> Range | None:
        a, b = self.start.shifted(rows, cols), self.end.shifted(rows, cols)
        return Range(a, b) if a and b else None

    def __str__(self) -> str:
        return f"{self.start}:{replace(self.end, sheet=None)}"


CELL = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)([1-9][0-9]{0,6})(?![A-Za-z0-9_(.])")
COLS = re.compile(r"(\$?)([A-Za-z]{1,3}):(\$?)([A-Za-z]{1,3})(?![A-Za-z0-9_(.])")
ROWS = re.compile(r"(\$?)([1-9][0-9]{0,6}):(\$?)([1-9][0-9]{0,6})(?![A-Za-z0-9_(.])")


def ordered(a: Ref, b: Ref) -> Range:
    """Corners put right; each axis keeps its anchor."""
    if a.col > b.col:
        a, b = replace(a, col=b.col, abs_col=b.abs_col), replace(b, col=a.col, abs_col=a.abs_col)
    if a.row > b.row:
        a, b = replace(a, row=b.row, abs_row=b.abs_row), replace(b, row=a.row, abs_row=a.abs_row)
    return Range(a, b)


def match_ref(text: str, at: int, sheet: str | None = None) -> tuple[Ref | Range, int] | None:
    """A reference that begins at `at`, and where it ends."""
    if m := COLS.match(text, at):
        return ordered(Ref(col_number(m[2]), 0, bool(m[1]), True, sheet), Ref(col_number(m[4]), 0, bool(m[3]), True, sheet)), m.end()
    if m := ROWS.match(text, at):
        return ordered(Ref(0, int(m[2]), True, bool(m[1]), sheet), Ref(0, int(m[4]), True, bool(m[3]), sheet)), m.end()
    if not (m := CELL.match(text, at)):
        return None
    first = Ref(col_number(m[2]), int(m[4]), bool(m[1]), bool(m[3]), sheet)
    if first.col > MAX_COLS or first.row > MAX_ROWS:
        return None
    if text[m.end() : m.end() + 1] == ":" and (n := CELL.match(text, m.end() + 1)):
        return ordered(first, Ref(col_number(n[2]), int(n[4]), bool(n[1]), bool(n[3]), sheet)), n.end()
    return first, m.end()


def parse_ref(text: str) -> Ref | Range:
    """A whole text as one reference, with an optional sheet name."""
    sheet, at = None, 0
    if m := re.match(r"(?:'((?:[^']|'')+)'|((?:\[[^\[\]]+\])?[A-Za-z_][\w.]*))!", text):
        sheet, at = (m[1] or m[2]).replace("''", "'"), m.end()
    found = match_ref(text, at, sheet)
    if not found or found[1] != len(text):
        raise ValueError(f"not a reference: {text!r}")
    return found[0]
