"""The row-filter grammar: comparisons, LIKE, BETWEEN, IN, IS [NOT] EMPTY, NOT, AND, OR, parentheses.

Two-valued: a type mismatch or an empty cell is no match, and NOT of it is TRUE. Text compares without case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.parser import FormulaError
from lattica.sheet import Sheet
from lattica.values import Val

TOKEN = re.compile(r"\s*(?:(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w])|'(?P<str>(?:[^']|'')*)'|\"(?P<str2>(?:[^\"]|\"\")*)\"|(?P<op><>|!=|<=|>=|=|<|>|\(|\)|,)|(?P<word>[A-Za-z_][\w.]*)|`(?P<name>[^`]+)`)")
OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
KEYWORDS = {"AND", "OR", "NOT", "LIKE", "BETWEEN", "IN", "IS", "EMPTY", "TRUE", "FALSE"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected text at {at} in {text!r}")
        kind = m.lastgroup or ""
        value = m[kind]
        if kind == "str":
            value = value.replace("''", "'")
        if kind == "str2":
            kind, value = "str", value.replace('""', '"')
        if kind == "word" and value.upper() in KEYWORDS:
            kind, value = "key", value.upper()
        out.append(("word", value) if kind == "name" else (kind, value))
        at = m.end()
    return out


class _Where:
    def __init__(self, sheet: Sheet, text: str) -> None:
        self.sheet, self.text, self.left = sheet, text, tokens(text)

    def peek(self, *want: str) -> bool:
        return bool(self.left) and self.left[0][0] in ("key", "op") and self.left[0][1] in want

    def take(self, *want: str) -> str | None:
        return self.left.pop(0)[1] if self.peek(*want) else None

    def need(self, *want: str) -> str:
        got = self.take(*want)
        if got is None:
            raise FormulaError(f"expected {' or '.join(want)} in {self.text!r}")
        return got

    def either(self) -> Column:
        out = self.both()
        while self.take("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.inverse()
        while self.take("AND"):
            out = out & self.inverse()
        return out

    def inverse(self) -> Column:
        if self.take("NOT"):
            return ~self.inverse()
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        return self.test()

    def literal(self) -> object:
        if not self.left:
            raise FormulaError(f"expected a value in {self.text!r}")
        kind, value = self.left.pop(0)
        if kind == "num":
            return float(value)
        if kind == "str":
            return value
        if kind == "key" and value in ("TRUE", "FALSE"):
            return value == "TRUE"
        raise FormulaError(f"expected a value, not {value!r}, in {self.text!r}")

    def test(self) -> Column:
        if not self.left or self.left[0][0] != "word":
            raise FormulaError(f"expected a column in {self.text!r}")
        name = self.sheet.resolve(self.left.pop(0)[1])
        v = self.sheet.val(self.sheet.columns.index(name) + 1)
        if self.take("IS"):
            no = self.take("NOT")
            self.need("EMPTY")
            empty = v.col.isNull() if v.kind != "text" else v.col.isNull() | (F.trim(v.col) == "")
            return ~empty if no else empty
        no = self.take("NOT")
        if self.take("LIKE"):
            out = like(v, str(self.literal()))
        elif self.take("BETWEEN"):
            lo = self.literal()
            self.need("AND")
            hi = self.literal()
            if type(lo) is not type(hi):
                raise FormulaError("BETWEEN's bounds must share a type")
            out = compared(v, ">=", lo) & compared(v, "<=", hi)
        elif self.take("IN"):
            self.need("(")
            out = compared(v, "=", self.literal())
            while self.take(","):
                out = out | compared(v, "=", self.literal())
            self.need(")")
        elif not no:
            out = compared(v, self.need(*OPS), self.literal())
        else:
            raise FormulaError(f"expected LIKE, BETWEEN or IN after NOT in {self.text!r}")
        return ~out if no else out


def compared(v: Val, op: str, x: object) -> Column:
    """Type-strict; what does not compare is FALSE."""
    if isinstance(x, bool):
        out = OPS[op](v.col, F.lit(x)) if v.kind == "bool" else F.lit(False)
    elif isinstance(x, float):
        out = OPS[op](v.col, F.lit(x)) if v.kind == "num" else F.lit(False)
    elif v.kind == "date":
        out = OPS[op](v.col, F.to_timestamp(F.lit(x))) if re.fullmatch(r"\d{4}-\d\d-\d\d.*", str(x)) else F.lit(False)
    else:
        out = OPS[op](F.lower(v.col), F.lit(str(x).lower())) if v.kind == "text" else F.lit(False)
    return F.coalesce(out, F.lit(False))


def like(v: Val, pattern: str) -> Column:
    """% alone is special."""
    if v.kind != "text":
        return F.lit(False)
    safe = pattern.lower().replace("\\", "\\\\").replace("_", "\\_")
    return F.coalesce(F.lower(v.col).like(safe), F.lit(False))


def where(sheet: Sheet, text: str) -> Column:
    w = _Where(sheet, text)
    out = w.either()
    if w.left:
        raise FormulaError(f"unexpected {w.left[0][1]!r} in {text!r}")
    return out
