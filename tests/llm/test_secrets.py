import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import secrets

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    """Base spans by three ordinary scans."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def base(text):
    return [s for s in secrets.scan(text) if s[0] in secrets.KINDS[:3]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Password", "api_key", "apikey", "PASSWD", "secret", " ", "=", ":", '"', "'", "AKIA", "ABCDEF123456", "0123456789abcdef", "é", "ſecret", "K", "\n", "x", "a1b2", "=="]), max_size=25).map("".join))
def test_base_spans_are_those_of_plain_scans(text):
    assert base(text) == plain(text)


def token(body):
    value, digits = zlib.crc32(body), b""
    for _ in range(6):
        value, r = divmod(value, 62)
        digits = secrets.BASE62[r : r + 1] + digits
    return (body + digits).decode()


def test_checksums():
    good = token(b"abcdefghij0123456789ABCDEFGHIJ")
    assert ("checked", 2, 42) in secrets.scan(f"é ghp_{good}.")
    assert not [s for s in secrets.scan(f"ghp_{good[:-1]}{'0' if good[-1] != '0' else '1'}") if s[0] == "checked"]
    assert [s[0] for s in secrets.scan("nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5")] == ["bech32"]
    assert not secrets.scan("nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe4")
    key = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    assert [s[0] for s in secrets.scan(key)] == ["base58"] and not secrets.scan(key[:-1] + "j")


def test_query(spark, sf, texts):
    for r in secrets.op1(spark, sf).collect():
        want = plain(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in secrets.KINDS[:3]]
        assert r.base_sha256 == hashlib.sha256(secrets.joined(want).encode()).hexdigest()


def test_odd_rows(odd, none, clashing):
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.secrets(odd).collect()]
    assert len(got) == 11 and (9, [("assign", 0, 18)]) in got and sum(bool(s) for _, s in got) == 1
    assert secrets.secrets(none).count() == 0 and secrets.secrets(clashing).count() == 6
