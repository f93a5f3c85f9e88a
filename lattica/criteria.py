"""The criteria mini-language of the SUMIF family, and its wildcards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.values import Val, parsed_number, plain, serial, to_text

OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "<>": lambda a, b: a != b}
FORM = re.compile(r"(<>|<=|>=|<|>|=)(.*)", re.S)


def as_number(text: str) -> float | None:
    try:
        return float(text.strip()) if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", text) else None
    except ValueError:
        return None


def has_wildcard(text: str) -> bool:
    return bool(re.search(r"(?<!~)(?:~~)*[*?]", text)) or "~" in text


def wildcard_regex(pattern: str) -> str:
    """An unanchored Java regular expression: * any run, ? one character, ~ takes the next one literally."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and pattern[i + 1 : i + 2] in ("*", "?", "~"):
            i += 1
            c = pattern[i]
            out += "\\" + c if c in "*?" else c
        elif c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        else:
            out += re.sub(r"([\\^$.|+()\[\]{}*?])", r"\\\1", c)
        i += 1
    return out


def wild(text: Column, pattern: str) -> Column:
    return text.rlike("(?is)^" + wildcard_regex(pattern) + "$")


def loose_number(v: Val) -> Column:
    """A cell as a number for comparing criteria: numbers, numeric text, Booleans, dates; else NULL."""
    return {"num": lambda: v.col.cast("double"), "text": lambda: parsed_number(v.col), "bool": lambda: v.col.cast("double"), "date": lambda: serial(v.col)}.get(v.kind, lambda: F.lit(None).cast("double"))()


def shown(v: Val) -> Column:
    """A cell's text for wildcards; NULL if empty."""
    return F.when(v.col.isNotNull(), to_text(v).col)


def matches(cell: Val, criterion: object) -> Column:
    """A two-valued Column: does the cell meet the criterion (a Python number, bool or text)?"""
    out = _matches(cell, criterion)
    out = F.coalesce(out, F.lit(False))
    return out if cell.err is None else out & cell.err.isNull()


def _matches(cell: Val, criterion: object) -> Column:
    if isinstance(criterion, bool):
        return {"bool": lambda: cell.col == criterion, "text": lambda: F.upper(cell.col) == str(criterion).upper()}.get(cell.kind, lambda: F.lit(False))()
    if isinstance(criterion, int | float):
        return equals_number(cell, float(criterion))
    text = str(criterion)
    m = FORM.fullmatch(text)
    if not m:
        return equals_text(cell, text, wildcards=True)
    op, rest = m[1], m[2]
    n = as_number(rest)
    if op == "=":
        return equals_number(cell, n) if n is not None else equals_text(cell, rest, wildcards=False)
    if n is not None:
        return OPS[op](loose_number(cell), F.lit(n))
    if op == "<>":
        if rest == "":
            return cell.col.isNotNull() & (F.lit(True) if cell.kind != "text" else cell.col != "")
        if has_wildcard(rest):
            return F.coalesce(~wild(shown(cell), rest), F.lit(True))
        return F.lit(True) if cell.kind != "text" else F.coalesce(F.lower(cell.col) != rest.lower(), F.lit(True))
    return OPS[op](F.lower(cell.col), F.lit(rest.lower())) if cell.kind == "text" else F.lit(False)


def equals_number(cell: Val, n: float) -> Column:
    if cell.kind == "bool":
        return F.lit(False)
    return loose_number(cell) == F.lit(n)


def equals_text(cell: Val, text: str, wildcards: bool) -> Column:
    if text == "":
        return cell.col.isNull() if cell.kind != "text" else cell.col.isNull() | (cell.col == "")
    if wildcards and has_wildcard(text):
        return wild(shown(cell), text)
    if (n := as_number(text)) is not None:
        return equals_number(cell, n)
    if text.upper() in ("TRUE", "FALSE"):
        return cell.col == (text.upper() == "TRUE") if cell.kind == "bool" else F.upper(cell.col) == text.upper() if cell.kind == "text" else F.lit(False)
    if cell.kind == "date":
        return F.date_format(cell.col, "yyyy-MM-dd") == text
    return F.lower(cell.col) == text.lower() if cell.kind == "text" else plain(cell.col.cast("double")) == text if cell.kind == "num" else F.lit(False)


def group_key(v: Val) -> Column:
    """One text for all cells that criteria equality treats alike, so that a criterion per row becomes an equi-join; NULL for a blank cell, which as a criterion means 0."""
    if v.kind == "text":
        n = parsed_number(v.col)
        return F.when(n.isNotNull(), F.concat(F.lit("n"), n.cast("string"))).otherwise(F.concat(F.lit("t"), F.lower(v.col)))
    if v.kind == "bool":
        return F.concat(F.lit("t"), v.col.cast("string"))
    return F.concat(F.lit("n"), (serial(v.col) if v.kind == "date" else v.col.cast("double")).cast("string"))
