"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits, then embedded checksums.

The text's UTF-8 bytes, A-Z lowered, go through one automaton of all keywords; a second automaton finds runs of hexadecimal digits in the text's character classes (its one keyword is HEX_LEAST class marks). Patterns are tried only where a keyword begins. Kinds:

- assign, access, hex: the base kinds, leftmost and non-overlapping within a kind, as a plain scan by their patterns would find them; a match that is too short is dropped but still consumes its text.
- checked: tokens of 30 base-62 digits and six more that encode their CRC-32.
- bech32: keys whose last six characters are a Bech32 checksum over prefix and data.
- base58: extended private keys whose last four bytes are the head of a double SHA-256.

The last three are added only where the checksum holds, so that lookalikes are left alone.

Defined results: a null text is empty and has no spans; very long texts are scanned whole; repeated rows are judged each by itself; an empty table gives no rows; ids pass through, null or not. Offsets are code points, end exclusive. Spans sort by start, then by kind in the order above.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import ASCII_LOWER, arrow_map, column, read

KINDS = ("assign", "access", "hex", "checked", "bech32", "base58")
#: Keywords by kind, lowered.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "bech32": ("nsec1", "age-secret-key-1"),
    "base58": ("xprv",),
}
#: Patterns by kind, tried where a keyword begins.
PATTERNS = {
    "assign": rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]+",
    "checked": rb"(?:gh[pousr]_|npm_)([0-9A-Za-z]{36})(?![0-9A-Za-z])",
    "bech32": rb"(?:nsec|AGE-SECRET-KEY-)1[0-9a-zA-Z]{20,90}(?![0-9a-zA-Z])",
    "base58": rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])",
}
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Alphabets of the checksums.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEX_CLASS = bytes(104 if x in b"0123456789abcdef" else 46 for x in range(256))


def crc_holds(body: bytes) -> bool:
    """30 base-62 digits, then their CRC-32 in six."""
    value = 0
    for c in body[30:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body[:30])


def bech32_holds(token: str) -> bool:
    if token.lower() != token and token.upper() != token:
        return False
    prefix, _, data = token.lower().rpartition("1")
    if not prefix or any(c not in BECH32 for c in data):
        return False
    check = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(BECH32.index, data)]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


def base58_holds(token: str) -> bool:
    value = 0
    for c in token:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


ACCEPTS = {
    "assign": lambda m: len(m[1]) >= ASSIGN_LEAST,
    "access": lambda m: len(m[0]) >= ACCESS_LEAST,
    "hex": lambda m: len(m[0]) >= HEX_LEAST,
    "checked": lambda m: crc_holds(m[1]),
    "bech32": lambda m: bech32_holds(m[0].decode()),
    "base58": lambda m: base58_holds(m[0].decode()),
}


@cache
def machines():
    """The keyword automaton, the one for hexadecimal runs, compiled patterns."""
    words = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for k in keys:
            words.add_word(k, (kind, len(k)))
    words.make_automaton()
    runs = ahocorasick.Automaton()
    runs.add_word("h" * HEX_LEAST, HEX_LEAST)
    runs.make_automaton()
    return words, runs, {k: re.compile(p) for k, p in PATTERNS.items()}


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, in code points."""
    raw = text.encode()
    words, runs, patterns = machines()
    near: dict[str, list[int]] = {}
    for end, (kind, n) in words.iter(raw.translate(ASCII_LOWER).decode("latin-1")):
        near.setdefault(kind, []).append(end - n + 1)
    marks = raw.translate(HEX_CLASS).decode("latin-1")
    at = 0
    while (hit := next(runs.iter(marks, at), None)) is not None:
        start = hit[0] - HEX_LEAST + 1
        near.setdefault("hex", []).append(start)
        at = patterns["hex"].match(raw, start).end()
    found = []
    for kind, starts in near.items():
        last = 0
        for s in sorted(starts):
            if s >= last and (m := patterns[kind].match(raw, s)):
                last = m.end()
                if ACCEPTS[kind](m):
                    found.append((s, KINDS.index(kind), m.end()))
    if len(raw) == len(text):
        return [(KINDS[k], s, e) for s, k, e in sorted(found)]
    points, done, count = {}, 0, 0
    for x in sorted({x for s, _, e in found for x in (s, e)}):
        count += len(raw[done:x].decode())
        points[x], done = count, x
    return [(KINDS[k], points[s], points[e]) for s, k, e in sorted(found)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id and spans (array of kind, start, end) for every row."""
    light = docs.select(column(docs, id_).alias("id"), column(docs, text).alias("text"))
    kind = light.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(row))], ["id", "spans"])

    return arrow_map(light, work, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked (spans whose checksum holds) for every document."""
    found = secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    name = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda *kinds: F.size(F.filter("spans", lambda x: x["kind"].isin(*kinds))).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(name(F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))), 256).alias("base_sha256"),
        name(F.col("spans")).alias("spans"), count("checked", "bech32", "base58").alias("n_checked"),
    )
