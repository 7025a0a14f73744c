"""All layers of a document are scanned, however long, deep or many they are."""

import base64
import bz2
import gzip
import zlib

import pytest

from cuepoint.llm import secrets

SECRET = 'password = "hunter2hunter2"'


def kinds(text):
    return {kind for kind, _, _ in secrets.scan(text)[1]}


def packed(data):
    return "see " + base64.b64encode(data).decode() + " end"


def test_long_text_with_an_escape():
    hidden = base64.b64encode(SECRET.encode()).decode()
    text = f"%41 {hidden}, " + "some words, " * (6 << 20) + f"é %42 {hidden}"
    assert len(text) > 64 << 20
    first, last = text.index(hidden), text.rindex(hidden)
    assert secrets.scan(text)[1] == [("assign", at, at + len(hidden)) for at in (first, last)]


def test_secret_behind_64_mb_of_a_payload():
    data = gzip.compress(b"words of a line.\n" * (4 << 20) + SECRET.encode(), 1)
    assert kinds(packed(data)) == {"assign"}


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, zlib.compress])
def test_all_members(pack):
    assert kinds(packed(pack(b"first member, ") + pack(b"second, ") + pack(SECRET.encode()))) == {"assign"}


def test_all_frames():
    zstandard = pytest.importorskip("zstandard")
    assert kinds(packed(zstandard.compress(b"first frame, ") + zstandard.compress(SECRET.encode()) + b"behind it")) == {"assign"}


def test_twelve_streams():
    data = SECRET.encode()
    for _ in range(4):
        data = bz2.compress(gzip.compress(zlib.compress(data)))
    assert kinds(packed(data)) == {"assign"}


def test_many_layers():
    assert ("access", 0, 20 + 2 * 1500 + 2) in secrets.scan("%" + "25" * 1500 + "41KIA" + "B" * 16)[1]


def test_windows_cut_nothing(monkeypatch):
    inner = base64.b64encode(SECRET.encode()).decode()
    data = gzip.compress(", ".join(f"é{i} {'AKIA' + 'C' * 16 if i == 700 else inner if i == 1400 else 'x' * (i % 90)}" for i in range(2000)).encode())
    whole = secrets.scan(packed(data))
    monkeypatch.setattr(secrets, "CHUNK_BYTES", 7)
    monkeypatch.setattr(secrets, "WINDOW_CHARS", 50)
    assert secrets.scan(packed(data)) == whole and kinds(packed(data)) == {"access", "assign"}


def test_damaged_streams():
    good = gzip.compress(SECRET.encode())
    assert kinds(packed(good + good[:-3])) == {"assign"}
    assert kinds(packed(b"x token=abcdef12")) == {"assign"}
    assert kinds(packed(good[:4] + b"\0" * 30)) == set()


def test_payloads_in_other_dress():
    import base64
    import bz2
    import gzip
    import textwrap
    import zlib
    from urllib.parse import quote_from_bytes

    import pytest

    zstandard = pytest.importorskip("zstandard")
    hidden = "some words and password=hunter2abc, then more words " * 20
    packers = (zlib.compress, lambda b: gzip.compress(b, mtime=0), bz2.compress, zstandard.ZstdCompressor().compress)
    dressed = [quote_from_bytes(pack(hidden.encode())) for pack in packers]
    dressed += [repr(pack(hidden.encode()))[2:-1] for pack in packers[:2]]
    dressed += [base64.b64encode(hidden.encode("utf-16-le")).decode(), base64.b64encode(hidden.encode("utf-16-be")).decode()]
    dressed += ["\n".join(textwrap.wrap(base64.b64encode(gzip.compress(hidden.encode(), mtime=0)).decode(), 76 if i else 64)) for i in range(2)]
    for k, run in enumerate(dressed):
        text = f"before {run} after"
        found = {(kind, text[a:b]) for kind, a, b in secrets.scan(text)[1]}
        assert any(kind == "assign" and len(part) > 0.9 * len(run) - 4 for kind, part in found), (k, run[:60], found)


def wrapped(data, width=76, end="\n", indent=""):
    text = base64.b64encode(data).decode()
    return (end + indent).join(text[i : i + width] for i in range(0, len(text), width))


NOISE = bytes((i * 197 + i // 7 * 31) % 256 for i in range(3000))


@pytest.mark.parametrize("window", [50, secrets.WINDOW_CHARS])
@pytest.mark.parametrize("end,indent", [("\n", ""), ("\r\n", ""), ("\n", "  \t "), ("\n", "\t\t")])
def test_base64_lines_across_windows(monkeypatch, window, end, indent):
    monkeypatch.setattr(secrets, "WINDOW_CHARS", window)
    monkeypatch.setattr(secrets, "CHUNK_BYTES", 999 if window == 50 else secrets.CHUNK_BYTES)
    block = wrapped(gzip.compress(NOISE[::3].hex().encode() + b", " + SECRET.encode()), end=end, indent=indent)
    inner = "some words, é\n" * 300 + f"begin:\n{block}\n-- end\n" + "more words\n" * 300
    assert "assign" in kinds(packed(gzip.compress(inner.encode())))
    assert "assign" in kinds(inner)


@pytest.mark.parametrize("encoded", ["first +", "last +", "each +", "+ and /", "no"])
@pytest.mark.parametrize("form", ["%2B", "\\x2b", "&#43;", "\\u002b"])
def test_base64_lines_with_encoded_characters(monkeypatch, encoded, form):
    data = gzip.compress(NOISE.hex().encode() + b", " + SECRET.encode())
    block = wrapped(data)
    assert block.count("+") > 2
    if encoded == "first +":
        block = block.replace("+", form, 1)
    elif encoded == "last +":
        block = form.join(block.rsplit("+", 1))
    elif encoded != "no":
        block = block.replace("+", form)
        if encoded == "+ and /":
            block = block.replace("/", form.replace("2B", "2F").replace("2b", "2f").replace("43", "47"))
    text = f"words\n{block}\nmore words"
    assert "assign" in kinds(text)
    monkeypatch.setattr(secrets, "WINDOW_CHARS", 50)
    assert "assign" in kinds(packed(gzip.compress((f"a line of words, {NOISE.hex()[:30]}\n" * 100 + text).encode())))


def test_large_payload_with_base64_lines():
    block = wrapped(gzip.compress(NOISE.hex().encode() + b", " + SECRET.encode()))
    half = "words of a line that goes on.\n" * (4_030_000 // 30)
    data = gzip.compress(f"{half}{block}\n{half}".encode(), 1)
    assert len(half) * 2 + len(block) > 8_000_000 and "assign" in kinds(packed(data))
