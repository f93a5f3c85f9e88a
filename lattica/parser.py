"""Formula text to a small syntax tree.

Precedence from loose to tight: infix OR; infix AND; comparisons; &; + -; * /; unary + - and prefix NOT; ^ (right-associative, so -2^2 is -4); postfix %.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from lattica.refs import Range, Ref, match_ref

MAX_LENGTH = 8192
#: The seven error codes.
ERRORS = ("#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!")


class FormulaError(ValueError):
    """A formula that cannot be parsed or bound."""


class Unsupported(FormulaError):
    """A formula that is right, but has no plan here; no error function catches it."""


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Logical:
    value: bool


@dataclass(frozen=True)
class ErrorLit:
    code: str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary:
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Node, ...]


Node = Num | Text | Logical | ErrorLit | Name | Unary | Binary | Call | Ref | Range

NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
STRING = re.compile(r'"((?:[^"]|"")*)"')
IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
SHEET = re.compile(r"(?:'((?:[^']|'')+)'|((?:\[[^\[\]]+\])?[A-Za-z_][\w.]*))!")
COMPARE = re.compile(r"<>|<=|>=|=|<|>")


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, *symbols: str) -> str | None:
        self.space()
        for s in symbols:
            if self.text.startswith(s, self.at):
                self.at += len(s)
                return s
        return None

    def word(self, *words: str) -> str | None:
        """A keyword that no parenthesis follows: AND(...) is a call."""
        self.space()
        m = IDENT.match(self.text, self.at)
        if m and m[0].upper() in words and self.text[m.end() :].lstrip()[:1] != "(":
            self.at = m.end()
            return m[0].upper()
        return None

    def fail(self, what: str) -> FormulaError:
        return FormulaError(f"{what} at {self.at} in {self.text!r}")

    def logical(self) -> Node:
        out = self.conjunction()
        while self.word("OR"):
            out = Call("OR", (out, self.conjunction()))
        return out

    def conjunction(self) -> Node:
        out = self.compare()
        while self.word("AND"):
            out = Call("AND", (out, self.compare()))
        return out

    def compare(self) -> Node:
        out = self.concat()
        while True:
            self.space()
            m = COMPARE.match(self.text, self.at)
            if not m:
                return out
            self.at = m.end()
            out = Binary(m[0], out, self.concat())

    def concat(self) -> Node:
        out = self.sum()
        while self.take("&"):
            out = Binary("&", out, self.sum())
        return out

    def sum(self) -> Node:
        out = self.product()
        while op := self.take("+", "-"):
            out = Binary(op, out, self.product())
        return out

    def product(self) -> Node:
        out = self.unary()
        while op := self.take("*", "/"):
            out = Binary(op, out, self.unary())
        return out

    def unary(self) -> Node:
        if op := self.take("+", "-"):
            return Unary(op, self.unary())
        if self.word("NOT"):
            return Call("NOT", (self.unary(),))
        return self.power()

    def power(self) -> Node:
        out = self.percent()
        if self.take("^"):
            return Binary("^", out, self.power_right())
        return out

    def power_right(self) -> Node:
        if op := self.take("+", "-"):
            return Unary(op, self.power_right())
        return self.power()

    def percent(self) -> Node:
        out = self.primary()
        while self.take("%"):
            out = Unary("%", out)
        return out

    def primary(self) -> Node:
        self.space()
        if self.take("("):
            out = self.logical()
            if not self.take(")"):
                raise self.fail("expected )")
            return out
        text, at = self.text, self.at
        if m := STRING.match(text, at):
            self.at = m.end()
            return Text(m[1].replace('""', '"'))
        for code in ERRORS:
            if text.startswith(code, at):
                self.at += len(code)
                return ErrorLit(code)
        if m := SHEET.match(text, at):
            sheet = m[1].replace("''", "'") if m[1] is not None else m[2]
            if found := match_ref(text, m.end(), sheet):
                self.at = found[1]
                return found[0]
            raise self.fail("expected a reference after the sheet name")
        if found := match_ref(text, at):
            self.at = found[1]
            return found[0]
        if m := NUMBER.match(text, at):
            self.at = m.end()
            return Num(float(m[0]))
        if m := IDENT.match(text, at):
            self.at = m.end()
            name = m[0]
            if self.take("("):
                return Call(name.upper(), self.args())
            if name.upper() in ("TRUE", "FALSE"):
                return Logical(name.upper() == "TRUE")
            return Name(name)
        raise self.fail("expected a value")

    def args(self) -> tuple[Node, ...]:
        if self.take(")"):
            return ()
        out = [self.logical()]
        while self.take(","):
            out.append(self.logical())
        if not self.take(")"):
            raise self.fail("expected )")
        return tuple(out)


def parse(formula: str) -> Node:
    if len(formula) > MAX_LENGTH:
        raise FormulaError(f"a formula has at most {MAX_LENGTH} characters")
    p = _Parser(formula.strip().removeprefix("="))
    out = p.logical()
    p.space()
    if p.at != len(p.text):
        raise p.fail("unexpected text")
    return out


def show(node: Node) -> str:
    """The tree as formula text, fully bracketed."""
    match node:
        case Num(v):
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
        case Text(v):
            return '"' + v.replace('"', '""') + '"'
        case Logical(v):
            return str(v).upper()
        case ErrorLit(c):
            return c
        case Name(n):
            return n
        case Unary("%", x):
            return f"({show(x)}%)"
        case Unary(op, x):
            return f"({op}{show(x)})"
        case Binary(op, a, b):
            return f"({show(a)}{op}{show(b)})"
        case Call(n, args):
            return f"{n}({','.join(map(show, args))})"
    return str(node)


def rewrite(node: Node, f) -> Node:
    """f on every reference and name, bottom up."""
    match node:
        case Unary(op, x):
            return Unary(op, rewrite(x, f))
        case Binary(op, a, b):
            return Binary(op, rewrite(a, f), rewrite(b, f))
        case Call(n, args):
            return Call(n, tuple(rewrite(x, f) for x in args))
        case Ref() | Range() | Name():
            return f(node)
    return node


def shift(node: Node, rows: int, cols: int = 0) -> Node:
    """The formula as a fill by so many rows and columns writes it."""
    return rewrite(node, lambda x: x if isinstance(x, Name) else x.shifted(rows, cols) or ErrorLit("#REF!"))


def references(node: Node) -> list[Ref | Range]:
    out: list[Ref | Range] = []
    rewrite(node, lambda x: (out.append(x) if not isinstance(x, Name) else None, x)[1])
    return out
