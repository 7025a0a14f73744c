"""Word-cached encoding with the ``tokenizers`` library.

White space is dropped by the vocabularies that this module accepts and never joins two words, so
the ids of a text are the ids of its space-separated chunks, one after the other. Chunks repeat,
so each worker remembers their ids and hands only new ones to the tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: Bytes of known chunks that a worker holds, about: two generations of half of it, of which the older
#: one goes when the younger is full. What is forgotten costs time and no ids.
CACHE_BYTES = 256 << 20
#: Bytes of a dictionary's entry, its key and its value beside their contents, about.
_ENTRY_BYTES = 150
#: Chunks longer than this are encoded each time they come.
CACHE_CHUNK_CHARS = 64

_GAP = re.compile(r"[^ \t\n\r]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: A word of Latin letters that lower-casing maps one to one and Unicode normalisation leaves alone,
#: and punctuation behind it, which the vocabulary's own pattern always parts from letters.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|)]*)")
_encoders: dict[str, "ChunkEncoder"] = {}


def _byte_letters() -> dict[int, int]:
    """Byte-level letters by rule: visible Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._room = CACHE_BYTES // 2
        self._by_chunk = sys.byteorder == "little" and array("I").itemsize == 4 and self._agrees()

    def _encode(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _agrees(self) -> bool:
        """Whether this vocabulary drops white space and lower-cases, as the short ways assume."""
        sample = ("Ab", "cd.", "éÀß", "ef!!", "x:|")
        together = b"".join(map(self._encode, sample))
        return self._encode(" ".join(sample)) == self._encode("\n\t".join(sample)) == together == b"".join(map(self._learn, sample))

    def _recall(self, piece: str) -> bytes | None:
        """Ids of a piece from either generation; the older one's are taken over."""
        ids = self._known.get(piece)
        if ids is None and (ids := self._older.get(piece)) is not None:
            self._remember(piece, ids)
        return ids

    def _remember(self, piece: str, ids: bytes) -> None:
        if len(piece) > CACHE_CHUNK_CHARS:
            return
        self._known[piece] = ids
        self._room -= _ENTRY_BYTES + len(piece) + len(ids)
        if self._room < 0:
            self._older, self._known, self._room = self._known, {}, CACHE_BYTES // 2

    def _learn(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            return self._encode(chunk)
        stem, rest = plain.groups()
        stem = stem.lower()
        ids = self._recall(stem)
        if ids is None:
            letters = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self._letters)
            ids = array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()
            self._remember(stem, ids)
        if not rest:
            return ids
        tail = self._recall(rest)
        if tail is None:
            tail = self._encode(rest)
            self._remember(rest, tail)
        return ids + tail

    def forget(self) -> None:
        """Give the memory of known chunks back, for workers that go on to other work."""
        self._known, self._older, self._room = {}, {}, CACHE_BYTES // 2

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._by_chunk:
            return self._encode(text)
        # str.split also parts at four separators that the vocabulary's pattern takes for text
        chunks = _GAP.findall(text) if _SEPARATORS.search(text) else text.split()
        ids = list(map(self._known.get, chunks))
        at = -1
        try:
            while True:
                at = ids.index(None, at + 1)
                chunk = chunks[at]
                new = self._known.get(chunk)
                if new is None:
                    new = self._older.get(chunk)
                    if new is None:
                        new = self._learn(chunk)
                    self._remember(chunk, new)
                ids[at] = new
        except ValueError:
            return b"".join(ids)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for this vocabulary file; loaded once for each worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
