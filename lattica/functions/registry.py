"""The function registry: name -> arity and compiler."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from lattica.parser import Call, FormulaError, Node
from lattica.values import Val, first_error, to_bool, to_date, to_int, to_num, to_text

COERCE = {"n": to_num, "i": to_int, "t": to_text, "b": to_bool, "d": to_date, "v": lambda v: v}


@dataclass(frozen=True)
class FunctionSpec:
    name: str
    least: int
    most: int | None
    compile: Callable
    elementwise: bool = False  # of values alone, so that a range as an argument means one result for each cell


FUNCTIONS: dict[str, FunctionSpec] = {}


def function(name: str, least: int, most: int | None = -1):
    """Registers a compiler (binder, argument nodes) -> Val. most: as least if left out, any number if None."""

    def put(f: Callable) -> Callable:
        FUNCTIONS[name] = FunctionSpec(name, least, least if most == -1 else most, f)
        return f

    return put


def scalar(name: str, kinds: str, least: int | None = None, binder: bool = False):
    """Registers a function of coerced values: kinds has a letter for each argument (number, integer, text, bool, date, value), a last * repeats the letter before it. Arguments' errors come first, left to right. binder: the function takes the binder before its arguments."""
    repeat = kinds.endswith("*")
    kinds = kinds.rstrip("*")

    def put(f: Callable) -> Callable:
        def compile_(b, args: tuple[Node, ...]) -> Val:
            vals = [COERCE[kinds[min(i, len(kinds) - 1)]](b.value(a)) for i, a in enumerate(args)]
            out = f(b, *vals) if binder else f(*vals)
            return Val(out.col, out.kind, first_error(*[v.err for v in vals], out.err))

        FUNCTIONS[name] = FunctionSpec(name, len(kinds) if least is None else least, None if repeat else len(kinds), compile_, True)
        return f

    return put


def call(b, name: str, args: tuple[Node, ...]) -> Val:
    from lattica import functions  # noqa: F401  registers all

    spec = FUNCTIONS.get(name)
    if spec is None:
        raise FormulaError(f"unknown function {name}")
    if len(args) < spec.least or (spec.most is not None and len(args) > spec.most):
        raise FormulaError(f"{name} takes {spec.least}{'' if spec.most == spec.least else ' or more' if spec.most is None else f' to {spec.most}'} arguments, not {len(args)}")
    return spec.compile(b, args)


def nested(name: str, args: tuple[Node, ...]) -> Call:
    return Call(name, args)
