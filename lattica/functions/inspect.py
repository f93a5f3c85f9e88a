"""Errors and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.registry import FUNCTIONS, FunctionSpec, function
from lattica.parser import FormulaError, Unsupported
from lattica.values import HOST, Val, aligned, error, to_num


def attempted(b, node) -> Val:
    """A value; a failure to bind it counts as a failure of the formula."""
    try:
        return b.value(node)
    except FormulaError as e:
        if isinstance(e, Unsupported) or "unknown function" in str(e) or "takes" in str(e):
            raise
        return error(HOST)


def caught(v: Val, alt: Val, when) -> Val:
    if v.err is None:
        return v
    cols, kind = aligned([v, alt])
    hit = F.coalesce(when(v.err), F.lit(False))
    none = F.lit(None).cast("string")
    return Val(F.when(hit, cols[1]).otherwise(cols[0]), kind, F.when(hit, alt.err if alt.err is not None else none).otherwise(v.err))


@function("IFERROR", 2)
def _iferror(b, args):
    return caught(attempted(b, args[0]), b.value(args[1]), lambda e: e.isNotNull())


@function("IFNA", 2)
def _ifna(b, args):
    return caught(b.value(args[0]), b.value(args[1]), lambda e: e == "#N/A")


@function("NA", 0)
def _na(b, args):
    return error("#N/A")


def errors_are(name: str, test) -> None:
    def compile_(b, args):
        v = attempted(b, args[0])
        return Val(F.lit(False) if v.err is None else F.coalesce(test(v.err), F.lit(False)), "bool")

    FUNCTIONS[name] = FunctionSpec(name, 1, 1, compile_)


errors_are("ISERROR", lambda e: e.isNotNull())
errors_are("ISERR", lambda e: e != "#N/A")
errors_are("ISNA", lambda e: e == "#N/A")


def kind_is(name: str, kind: str) -> None:
    def compile_(b, args):
        v = attempted(b, args[0])
        there = v.col.isNotNull() if v.kind == kind else F.lit(False)
        return Val(there if v.err is None else there & v.err.isNull(), "bool")

    FUNCTIONS[name] = FunctionSpec(name, 1, 1, compile_)


kind_is("ISNUMBER", "num")
kind_is("ISTEXT", "text")


@function("ISBLANK", 1)
def _isblank(b, args):
    v = attempted(b, args[0])
    return Val(v.col.isNull() if v.err is None else v.col.isNull() & v.err.isNull(), "bool")


@function("N", 1)
def _n(b, args):
    v = b.value(args[0])
    return Val(F.lit(0.0), "num", v.err) if v.kind == "text" else to_num(v)
