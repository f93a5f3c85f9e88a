"""Text. Lengths and positions count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.criteria import has_wildcard, wildcard_regex
from lattica.functions.registry import function, scalar
from lattica.parser import FormulaError
from lattica.values import HOST, Val, first_error, serial, to_num, to_text


def text(col: Column, err: Column | None = None) -> Val:
    return Val(col, "text", err)


def num(col: Column, err: Column | None = None) -> Val:
    return Val(col.cast("double"), "num", err)


scalar("CONCATENATE", "t*")(lambda *x: text(F.concat(*[v.col for v in x])))
scalar("LEFT", "ti")(lambda s, n: text(F.substring(s.col, F.lit(1), F.greatest(n.col, F.lit(0)).cast("int")), F.when(n.col < 0, F.lit(HOST))))
scalar("LEN", "t")(lambda s: num(F.char_length(s.col)))
scalar("UPPER", "t")(lambda s: text(F.upper(s.col)))
scalar("LOWER", "t")(lambda s: text(F.lower(s.col)))
scalar("TRIM", "t")(lambda s: text(F.trim(F.regexp_replace(s.col, " +", " "))))
scalar("RIGHT", "ti")(lambda s, n: text(F.when(n.col > 0, F.right(s.col, n.col.cast("int"))).otherwise(""), F.when(n.col < 0, F.lit(HOST))))


@scalar("MID", "tii")
def _mid(s, at, n):
    bad = (at.col < 1) | (n.col < 0)
    return text(F.when(~bad, F.substring(s.col, F.greatest(at.col, F.lit(1)).cast("int"), F.greatest(n.col, F.lit(0)).cast("int"))), F.when(bad, F.lit(HOST)))


@scalar("FIND", "tti", 2)
def _find(needle, s, start=None):
    at = F.lit(1) if start is None else start.col.cast("int")
    found = F.call_function("locate", needle.col, s.col, at)
    bad = (at < 1) | (at > F.char_length(s.col) + 1) | (found == 0)
    found = F.when(needle.col == "", at).otherwise(found)
    return num(F.when(~bad | (needle.col == ""), found), F.when(bad & (needle.col != ""), F.lit(HOST)))


@function("SEARCH", 2, 3)
def _search(b, args):
    needle, s = to_text(b.value(args[0])), to_text(b.value(args[1]))
    start = F.lit(1) if len(args) < 3 else to_num(b.value(args[2])).col.cast("int")
    if isinstance(needle.const, str) and has_wildcard(needle.const):
        at = F.regexp_instr(F.substring(s.col, start, F.lit(2**31 - 1)), F.lit("(?is)" + wildcard_regex(needle.const)))
        found = F.when(at > 0, at + start - 1).otherwise(0)
    else:
        found = F.call_function("locate", F.lower(needle.col), F.lower(s.col), start)
    bad = (start < 1) | (found == 0)
    return num(F.when(~bad, found), first_error(needle.err, s.err, F.when(bad, F.lit("#VALUE!"))))


@function("SUBSTITUTE", 3, 4)
def _substitute(b, args):
    s, old, new = (to_text(b.value(a)) for a in args[:3])
    err = first_error(s.err, old.err, new.err)
    if len(args) == 3:
        return text(F.when(old.col == "", s.col).otherwise(F.replace(s.col, old.col, new.col)), err)
    k = to_num(b.value(args[3])).col.cast("int")
    parts = F.split(s.col, F.concat(F.lit("\\Q"), old.col, F.lit("\\E")), -1)
    n = F.size(parts)
    joined = lambda x: F.call_function("array_join", x, old.col)
    swapped = F.concat(joined(F.slice(parts, F.lit(1), F.greatest(k, F.lit(0)))), new.col, joined(F.slice(parts, F.greatest(k, F.lit(0)) + 1, F.greatest(n - k, F.lit(0)))))
    ok = (k >= 1) & (k < n) & (old.col != "")
    return text(F.when(ok, swapped).otherwise(s.col), first_error(err, F.when(k < 1, F.lit(HOST))))


@function("VALUE", 1)
def _value(b, args):
    """Currency signs, thousands commas, percent, accounting parentheses, exponents."""
    v = b.value(args[0])
    if v.kind != "text":
        return Val(to_num(v).col, "num", first_error(v.err, F.when(v.col.isNotNull(), F.lit("#VALUE!")) if v.kind == "date" else None))
    s = F.trim(v.col)
    pct = s.endswith("%")
    body = F.trim(F.regexp_replace(s, "%$", ""))
    paren = body.rlike(r"^\([^()]*\)$")
    inner = F.when(paren, F.regexp_extract(body, r"^\((.*)\)$", 1)).otherwise(body)
    fits = inner.rlike(r"^[+-]?\$?[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?$") & ~(paren & inner.rlike("[+-](?![0-9]*$)|^[+-]"))
    n = F.regexp_replace(inner, "[$,]", "").try_cast("double")
    n = F.when(paren, -n).otherwise(n) / F.when(pct, 100).otherwise(1)
    bad = (s != "") & (~fits | n.isNull())
    return num(F.when(F.coalesce(s, F.lit("")) == "", 0.0).when(~bad, n), first_error(v.err, F.when(bad, F.lit("#VALUE!"))))


DATE_TOKEN = re.compile(r"yyyy|yy|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss|s|AM/PM", re.I)


def date_pattern(fmt: str) -> str:
    """A spreadsheet date format as Spark's; m after h or before s means minutes."""
    out, at, hours = "", 0, False
    half = "am/pm" in fmt.lower()
    for m in DATE_TOKEN.finditer(fmt):
        gap = fmt[at : m.start()]
        out += "".join(f"'{c}'" if c.isalpha() else c for c in gap)
        t = m[0].lower()
        minutes = t in ("m", "mm") and (hours or re.match(r"[^a-z]*s", fmt[m.end() :], re.I))
        out += {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "mm" if minutes else "MM", "m": "m" if minutes else "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "hh": "hh" if half else "HH", "h": "h" if half else "H", "ss": "ss", "s": "s", "am/pm": "a"}[t]
        hours = t in ("h", "hh") or (hours and not minutes and t not in ("m", "mm"))
        at = m.end()
    return out + "".join(f"'{c}'" if c.isalpha() else c for c in fmt[at:])


NUMBER_FORMAT = re.compile(r'([^0#?.,%]*)([#0?,]*)(?:\.([0#?]*))?([eE]\+0+)?(%?)([^0#?.,%]*)')


def number_text(n: Column, fmt: str) -> Column:
    """One section of a number format: prefix, digits with thousands, decimals, exponent, percent, suffix."""
    m = NUMBER_FORMAT.fullmatch(fmt)
    if not m:
        raise FormulaError(f"unsupported number format {fmt!r}")
    clean = lambda s: re.sub(r'"([^"]*)"|\\(.)', lambda x: x[1] if x[1] is not None else x[2], s)
    whole, decimals = m[2], m[3] or ""
    x = n * 100 if m[5] else n
    if m[4]:
        places = len(decimals)
        power = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
        body = F.concat(F.format_string(f"%.{places}f", x / F.pow(F.lit(10.0), power)), F.lit("E"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), len(m[4]) - 2, "0"))
    else:
        body = F.format_number(F.round(x, len(decimals)), len(decimals)) if "," in whole else F.format_string(f"%.{len(decimals)}f", F.round(x, len(decimals)))
        optional = len(decimals) - len(decimals.rstrip("#"))
        if optional:
            body = F.regexp_replace(body, rf"(\.\d{{{len(decimals) - optional}}}\d*?)0+$", "$1") if optional < len(decimals) else F.regexp_replace(F.regexp_replace(body, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        least = whole.replace(",", "").count("0")
        if least > 1 and "," not in whole:
            body = F.lpad(body, F.greatest(F.char_length(body), F.lit(least + (len(decimals) + 1 if decimals else 0))), F.lit("0")) if decimals == "" or not optional else body
        if least == 0:
            body = F.regexp_replace(body, r"^(-?)0(?=\.|$)", "$1")
    return F.concat(F.lit(clean(m[1])), body, F.lit(m[5] + clean(m[6])))


#: A section's condition, its colour, and a fraction among its characters.
CONDITION = re.compile(r"\[(<=|>=|<>|<|>|=)\s*(-?\d+(?:\.\d+)?)\]")
COLOUR = re.compile(r"\[(?:black|blue|cyan|green|magenta|red|white|yellow|color ?\d+)\]", re.I)
FRACTION = re.compile(r"(.*?)([#0?]*)([^#0?]*?)([#0?]+)/([#0?]+|[1-9]\d*)(.*)", re.S)
TESTS = {"<": lambda a, x: a < x, "<=": lambda a, x: a <= x, ">": lambda a, x: a > x, ">=": lambda a, x: a >= x, "=": lambda a, x: a == x, "<>": lambda a, x: a != x}


def unquoted(s: str) -> str:
    return re.sub(r'"([^"]*)"|\\(.)', lambda x: x[1] if x[1] is not None else x[2], s)


def sections(fmt: str) -> list[tuple[tuple[str, float] | None, str]]:
    """Sections with their conditions; colours are left out."""
    out = []
    for part in re.findall(r'((?:"[^"]*"|\\.|[^;"\\])*)(?:;|$)', fmt)[: fmt.count(";") + 1]:
        part = COLOUR.sub("", part)
        m = CONDITION.match(part)
        out.append(((m[1], float(m[2])), part[m.end() :]) if m else (None, part))
    return out


def convergent(x: Column, most: int) -> Column:
    """The last convergent of x >= 0 as a continued fraction whose denominator is at most `most`: struct (p, q)."""
    start = F.struct(x.alias("b"), F.lit(1.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("p0"), F.lit(1.0).alias("q0"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        a = F.floor(s["b"]).cast("double")
        p, q = a * s["p"] + s["p0"], a * s["q"] + s["q0"]
        over = s["done"] | (q > most)
        rest = s["b"] - a
        pick = lambda old, new: F.when(over, old).otherwise(new)
        return F.struct(pick(s["b"], F.coalesce(F.try_divide(F.lit(1.0), rest), F.lit(0.0))).alias("b"), pick(s["p"], p).alias("p"), pick(s["q"], q).alias("q"), pick(s["p0"], s["p"]).alias("p0"), pick(s["q0"], s["q"]).alias("q0"), (over | (rest < 5e-8)).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step)


def placed(digits: Column, holes: str, right: bool) -> Column:
    """Digits in placeholders: ? is a space where nothing stands, 0 a zero, # nothing."""
    fill = "".join({"?": " ", "0": "0"}.get(h, "") for h in holes)
    if not fill:
        return digits
    width = F.greatest(F.char_length(digits), F.lit(len(fill)))
    zero = "0" in fill
    return F.lpad(digits, width, F.lit("0" if zero else " ")) if right else F.rpad(digits, width, F.lit(" "))


def fraction_text(n: Column, m: re.Match) -> Column:
    """A number that is not negative as a whole part, if the format has one, and a fraction."""
    head, whole, gap, up, down, tail = m.groups()
    fixed = int(down) if down[0] in "123456789" else None
    digits = lambda c: c.cast("bigint").cast("string")
    if fixed:
        rounded = F.floor(n * fixed + 0.5)
        w, p, q = F.floor(rounded / fixed), rounded % fixed, F.lit(fixed)
    else:
        c = convergent(n, 10 ** min(max(len(up), len(down)), 7) - 1)
        w = F.floor(c["p"] / c["q"])
        p, q = c["p"] - w * c["q"], c["q"]
    top = p if whole else p + w * q
    body = F.concat(placed(digits(top), up, True), F.lit("/"), F.lit(down) if fixed else placed(digits(q), down, False))
    if whole:
        seen = lambda s: len(s.replace("#", ""))
        blank = " " * (seen(up) + 1 + (len(down) if fixed else seen(down)))
        body = F.concat(F.when(w > 0, placed(digits(w), whole, True)).when(p == 0, F.lit("0")).otherwise(placed(F.lit(""), whole, True)), F.lit(unquoted(gap)), F.when(p == 0, F.lit(blank)).otherwise(body))
    return F.concat(F.lit(unquoted(head)), body, F.lit(unquoted(tail)))


def section_text(n: Column, fmt: str) -> Column:
    """A number that is not negative by one section."""
    bare = re.sub(r'"[^"]*"|\\.', "", fmt)
    if "/" in bare and (m := FRACTION.fullmatch(fmt)):
        return fraction_text(n, m)
    if bare in ("General", ""):
        return to_text(Val(n, "num")).col if bare else F.lit(unquoted(fmt))
    return number_text(n, fmt)


def formatted(v: Val, fmt: str) -> Column:
    if v.kind == "text":
        return to_text(v).col
    letters = re.sub(r'"[^"]*"|\\.|E\+|e\+|\[[^\]]*\]|General', "", fmt)
    if re.search("[ymdhs]", letters, re.I) and not re.search("[0#]", letters):
        at = v.col.cast("timestamp_ntz") if v.kind == "date" else (F.timestamp_micros(((to_num(v).col - 25569) * 86_400_000_000).cast("bigint"))).cast("timestamp_ntz")
        return F.date_format(at, date_pattern(fmt))
    n = serial(v.col) if v.kind == "date" else to_num(v).col
    if fmt in ("@", "General"):
        return to_text(v).col
    parts = sections(fmt)
    signed = lambda s: F.when(n < 0, F.concat(F.lit("-"), section_text(F.abs(n), s))).otherwise(section_text(F.abs(n), s))
    if any(c for c, _ in parts):  # the first section whose condition holds; one without a condition takes the rest
        out = F.when(F.lit(False), F.lit(""))
        for condition, s in parts:
            if condition is None:
                return out.otherwise(signed(s))
            out = out.when(TESTS[condition[0]](n, F.lit(condition[1])), signed(s))
        return out.otherwise(F.lit("#" * 8))
    if len(parts) == 1:
        return signed(parts[0][1])
    out = F.when(n < 0, section_text(F.abs(n), parts[1][1]))
    if len(parts) > 2:
        out = out.when(n == 0, section_text(F.abs(n), parts[2][1]))
    return out.otherwise(section_text(F.abs(n), parts[0][1]))


@function("TEXT", 2)
def _text(b, args):
    fmt = b.constant(args[1])
    if not isinstance(fmt, str):
        raise FormulaError("TEXT's format must be a constant text")
    v = b.value(args[0])
    return text(F.lit("") if fmt == "" else formatted(v, fmt), v.err)
