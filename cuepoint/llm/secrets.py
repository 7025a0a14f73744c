"""Secret scanning through nested encodings.

A worklist starts with the text itself. From each layer come further ones: percent-encoding and
Unicode escapes undone in place, base64 runs decoded, compressed payloads unpacked. Every new layer
is scanned by the same patterns and put on the list, until nothing new appears; layers are known by
their content and place, so cycles end. What is found is mapped to the characters of the original
text that it came from: escapes character by character, decoded runs as a whole.

An in-place layer is the parts of its text in which something was undone; the others were scanned
before. Compressed payloads are unpacked whole, all members and streams in streams, and scanned in
windows that end where no pattern and no encoding can go on, so a window more or less changes nothing.

Cases: null and empty texts have no spans; other rows and columns don't matter, so nulls, repeated
rows and empty tables need no care. Whole texts and whole layers are scanned; memory follows the text
and ``WINDOW_CHARS``, or the longest run without a separator in what is unpacked, if that is longer.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import io
import re
import tempfile
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from typing import IO
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: Characters of an unpacked payload that are scanned at a time, about, and bytes that are read at a time.
WINDOW_CHARS, CHUNK_BYTES = 4 << 20, 1 << 20
#: Bytes that zstandard is given at a time; they hold at most as many blocks of 128 kB as a quarter of them.
_ZSTD_BYTES = 256
#: Shortest run that is tried as base64.
BASE64_CHARS = 16

_ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A run that is too short has no long enough run inside, so the length is part of these two patterns.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};)+")
_ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#x([0-9A-Fa-f]+);")
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{BASE64_CHARS},}}={{0,2}}")

#: Base64 in lines of a fixed width, as in PEM and MIME parts.
_BASE64_LINES = re.compile(r"(?:[A-Za-z0-9+/]{40,}\r?\n[ \t]*)+[A-Za-z0-9+/]+={0,2}")
#: Compressed payloads with their unprintable bytes percent-encoded or escaped, from the first bytes of each format on.
_PERCENT_PACKED = re.compile(r"(?:%1[Ff]%8[Bb]|x%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|BZh[1-9]1AY%26SY|%28%[Bb]5(?:/|%2[Ff])%[Ff][Dd])(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/-])+")
_ESCAPED_PACKED = re.compile(r"(?:\\x1f\\x8b|x(?:\\x01|\^|\\x9c|\\xda)|BZh[1-9]1AY&SY|\(\\xb5/\\xfd)(?:\\x[0-9A-Fa-f]{2}|\\[nrt'\"\\]|[ !#-&(-\[\]-~])+", re.IGNORECASE)

#: Characters that the patterns and encodings above consist of; texts fall apart at all others.
_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"': %\\{};&#")
_SEPARATOR = re.compile(r"""[^A-Za-z0-9+/_.=\-"': %\\{};&#]""")
#: A line that may be one of base64, some of it encoded: the break behind it doesn't part what goes on.
_LINE = re.compile(r"[A-Za-z0-9+/%\\{};&#]{40}\r?")

Span = tuple[int, int]
Place = Callable[[int, int], Span]
#: Maps to the enclosing layer, from the inside out; a loop walks them, as layers may be many.
Chain = tuple[Place, "Chain"] | None


def matches(text: str) -> list[tuple[str, int, int]]:
    """Base matches ``(kind, start, end)`` of one layer."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _ordered(found: set[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _unescaped(run: str) -> str | None:
    units = []
    for m in _ONE_ESCAPE.finditer(run):
        code = int(m[4]) if m[4] else int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF:
            return None
        units.append(chr(code))
    return "".join(units).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None


def _separates(text: str, at: int) -> bool:
    """Whether nothing that is looked for goes on across a character that no pattern holds.

    Line breaks and the blanks behind them are in base64 of several lines. Where too little of the text before
    is known, they count as such.
    """
    if text[at] == "\t":
        return at > 0 and text[at - 1] not in "\n\t "
    if text[at] not in "\r\n":
        return True
    line = text[max(0, at - 41) : at]
    if len(line) < 41:
        return _SEPARATOR.search(line.removesuffix("\r")) is not None
    return not (_LINE.fullmatch(line) or _LINE.fullmatch(line, 1))


def _last_separator(text: str, start: int, end: int) -> int:
    """Place of the last separator of a part of the text, or -1."""
    while end > start and (text[end - 1] in _INSIDE or not _separates(text, end - 1)):
        end -= 1
    return end - 1 if end > start else -1


def _first_separator(text: str, start: int, end: int) -> int:
    """Place of the first separator of a part of the text, or -1."""
    return next((m.start() for m in _SEPARATOR.finditer(text, start, end) if _separates(text, m.start())), -1)


def _in_place(text: str, pattern: re.Pattern, decode: Callable[[str], str | None]) -> tuple[str, Place] | None:
    """The parts of the text with runs to decode, decoded, and where their characters come from."""
    pieces, at, new = [], 0, 0
    begins, origins, whole = [0], [0], [False]  # from this new position on; from this old one; a decoded run
    for m in pattern.finditer(text):
        decoded = decode(m[0])
        if decoded is None:
            continue
        last = _last_separator(text, at, m.start())
        first = _first_separator(text, at, m.start()) if len(begins) > 1 and last >= 0 else -1
        if last >= 0 and first < last:
            if first >= 0:
                pieces.append(text[at : first + 1])
                new += first + 1 - at
            begins.append(new)
            origins.append(last)
            whole.append(False)
            at = last
        pieces += [text[at : m.start()], decoded]
        new += m.start() - at
        begins.append(new)
        origins.append(m.start())
        whole.append(True)
        new += len(decoded)
        begins.append(new)
        origins.append(m.end())
        whole.append(False)
        at = m.end()
    if len(begins) == 1:
        return None
    rest = _first_separator(text, at, len(text))
    pieces.append(text[at : rest + 1 if rest >= 0 else len(text)])
    ends = [*origins[1:], len(text)]

    def place(start: int, end: int) -> Span:
        i, j = bisect_right(begins, start) - 1, bisect_right(begins, end - 1) - 1
        return (origins[i] if whole[i] else origins[i] + start - begins[i], ends[j] if whole[j] else origins[j] + end - begins[j])

    return "".join(pieces), place


def _origin(chain: Chain, start: int, end: int) -> Span:
    while chain:
        own, chain = chain
        start, end = own(start, end)
    return start, end


def _codec(head: bytes) -> str | None:
    """The compression that the first bytes of a stream stand for."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return "zlib"
    if head[:3] == b"BZh":
        return "bz2"
    return "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _members(source: IO[bytes]) -> Iterator[bytes]:
    """What all members of a compressed stream unpack to, piece by piece; EOFError if the last is cut short."""
    data = source.read(CHUNK_BYTES)
    while codec := _codec(data):
        if codec == "zstd":
            import zstandard

            member = zstandard.ZstdDecompressor().decompressobj()
            while not member.eof:
                if not data and not (data := source.read(CHUNK_BYTES)):
                    raise EOFError
                yield member.decompress(data[:_ZSTD_BYTES])  # it has no limit of its own
                data = data[_ZSTD_BYTES:]
            data = member.unused_data + data
        elif codec == "bz2":
            member = bz2.BZ2Decompressor()
            while not member.eof:
                if member.needs_input and not data and not (data := source.read(CHUNK_BYTES)):
                    raise EOFError
                yield member.decompress(data, CHUNK_BYTES)
                data = b""
            data = member.unused_data
        else:
            member = zlib.decompressobj(31 if codec == "gzip" else 15)
            while not member.eof:
                if not data and not (data := source.read(CHUNK_BYTES)):
                    yield member.flush()
                    if not member.eof:
                        raise EOFError
                    break
                yield member.decompress(data, CHUNK_BYTES)
                data = member.unconsumed_tail
            data = member.unused_data
        data = (data + source.read(CHUNK_BYTES)).lstrip(b"\0")


class _Unpacked:
    """A compressed stream's content, as often as it is read; ``damaged`` once a reading found it so."""

    def __init__(self, source: IO[bytes]):
        self.source, self.damaged = source, False

    def __iter__(self) -> Iterator[bytes]:
        self.source.seek(0)
        try:
            yield from _members(self.source)
        except (zlib.error, OSError, ValueError, EOFError):
            self.damaged = True
        except Exception as error:  # zstandard's own error type
            if type(error).__module__.split(".")[0] != "zstandard":
                raise
            self.damaged = True


def _head(pieces: _Unpacked) -> bytes:
    head = b""
    for piece in pieces:
        head += piece
        if len(head) >= 4:
            break
    return head


def _shown(text: str) -> int:
    if text.isprintable():
        return len(text)
    return sum(n for c, n in Counter(text).items() if c.isprintable() or c in "\t\r\n")


def _decoded(pieces: _Unpacked) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")()
    for piece in pieces:
        yield decoder.decode(piece)
    yield decoder.decode(b"", not pieces.damaged)


def _windows(pieces: _Unpacked) -> Iterator[str]:
    """The readable content of a stream in windows that end at separators; nothing if it isn't readable."""
    total = shown = 0
    try:
        for text in _decoded(pieces):
            total += len(text)
            shown += _shown(text)
    except UnicodeDecodeError:
        return
    if shown < 0.95 * total:
        return
    ready, tail, size, before = [], [], 0, ""
    for text in _decoded(pieces):
        known = before + text
        cut = max(_last_separator(known, len(before), len(known)) + 1 - len(before), 0)
        before = known[-64:]
        if cut:
            ready += [*tail, text[:cut]]
            tail = []
        tail.append(text[cut:])
        size += len(text)
        if size >= WINDOW_CHARS and ready:
            yield "".join(ready)
            ready, size = [], sum(map(len, tail))
    yield "".join(ready + tail)


def _unpacked(data: bytes) -> Iterator[str]:
    """Texts of a compressed payload: its innermost stream, and those on the way that turn out to be damaged
    or none at all."""
    level, seen = io.BytesIO(data), set()
    while True:
        pieces = _Unpacked(level)
        if not _codec(_head(pieces)):
            yield from _windows(pieces)
            if pieces.damaged:
                level.seek(0)
                if (text := _readable(level.read())) is not None:
                    yield text
            return
        inner, digest = tempfile.SpooledTemporaryFile(WINDOW_CHARS), hashlib.blake2b(digest_size=16)
        for piece in pieces:
            inner.write(piece)
            digest.update(piece)
        level.close()
        if digest.digest() in seen:  # a stream that unpacks to itself
            return
        seen.add(digest.digest())
        level = inner


def _readable(data: bytes) -> str | None:
    """The text of UTF-8, or of UTF-16 in which one byte of most characters is zero."""
    low, high = data[::2].count(0), data[1::2].count(0)
    code = "utf-16-le" if 4 * high > len(data) else "utf-16-be" if 4 * low > len(data) else "utf-8"
    try:
        text = data.decode(code).removeprefix("\ufeff")
    except UnicodeDecodeError:
        return None
    shown = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and shown >= 0.95 * len(text) else None


def _from_base64(run: str) -> str | Iterator[str] | None:
    """The text that a run stands for, or its windows if it is compressed."""
    body = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None
    return _unpacked(data) if _codec(data) else _readable(data)


def _payloads(layer: str) -> Iterator[tuple[str | Iterator[str], Span]]:
    """What encoded runs stand for as a whole, and where they are: a text, or the windows of a compressed one."""
    for m in _BASE64.finditer(layer):
        if (inner := _from_base64(m[0])) is not None:
            yield inner, m.span()
    if "\n" in layer:
        for m in _BASE64_LINES.finditer(layer):
            if (inner := _from_base64("".join(m[0].split()))) is not None:
                yield inner, m.span()
    if "%" in layer:
        for m in _PERCENT_PACKED.finditer(layer):
            yield _unpacked(unquote_to_bytes(m[0])), m.span()
    if "\\x" in layer:
        for m in _ESCAPED_PACKED.finditer(layer):
            yield _unpacked(codecs.escape_decode(m[0].encode("ascii"))[0]), m.span()


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of one text, in order."""
    if not text:
        return [], []
    base = set(matches(text))
    found = set(base)
    work: list[tuple[str | Iterator[str], Chain]] = [(text, None)]
    seen: set[tuple[bytes, Span]] = set()

    def add(layer: str, chain: Chain) -> None:
        """Scans a new layer and puts it on the list. A layer that is known by content and place may still have
        come another way, from other characters of that place."""
        if not layer:
            return
        found.update((kind, *_origin(chain, s, e)) for kind, s, e in matches(layer))
        key = (hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), _origin(chain, 0, len(layer)))
        if key not in seen:
            seen.add(key)
            work.append((layer, chain))

    while work:
        layer, chain = work.pop()
        if not isinstance(layer, str):
            window = next(layer, None)
            if window is not None:
                work.append((layer, chain))
                add(window, chain)
            continue
        for mark, pattern, decode in (("%", _PERCENT, _percent), ("\\", _ESCAPE, _unescaped), ("&#", _ESCAPE, _unescaped)):
            if mark in layer and (inner := _in_place(layer, pattern, decode)):
                add(inner[0], (inner[1], chain))
        for inner, span in _payloads(layer):
            outer = _origin(chain, *span)
            own = (lambda s, e, outer=outer: outer, None)
            if isinstance(inner, str):
                add(inner, own)
            else:
                work.append((inner, own))
    return _ordered(base), _ordered(found)


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base and spans (both as listed text)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, spans = [[] for _ in KINDS], [], []
            for text in batch.column("text"):
                own, every = scan(text.as_py())
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in own))
                base.append(_listed(own))
                spans.append(_listed(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], names)

    return source.mapInArrow(look, f"doc_id {key}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
