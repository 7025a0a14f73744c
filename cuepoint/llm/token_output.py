"""Token-id output compressed by a Re-Pair grammar, shard by shard.

Documents are sorted by id across the cluster; each task encodes its range and cuts it into shards of
about ``shard_tokens`` ids. Within a shard frequent neighbouring pairs are replaced by nonterminals,
round after round, until no pair comes often enough or the symbols are used up. A shard keeps its
rules, the expansion length of each rule, where each document begins and how many ids come before each
block of symbols. A document is found by two binary searches, and only the symbols that it touches are
expanded, from the top down and without what lies outside it. Shards are rows of a Parquet table, which gives them the atomic
commit and the retries of Spark's own writer on any store.

Cases: a null or empty text is the end id alone; null ``doc_id`` sort last; rows with equal ids sort
by their text, and exactly repeated rows are written as often as they come; an empty table gives an
empty output; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tokens import encoder

_HEADER = struct.Struct("<4sBIIQQ")  # magic, symbol bytes, first nonterminal, rules, documents, symbols
_MAGIC = b"CPR2"
#: Symbols of a block, before each of which a shard keeps the number of ids.
BLOCK_SYMBOLS = 1024
#: Ids of the expansions that a reader holds as a table: the shortest ones, up to this many in all.
TABLE_IDS = 1 << 22
#: A pair is replaced while it comes this often in its shard.
MIN_PAIR_COUNT = 8
#: Most nonterminals that one round adds; counts are taken anew after each round.
ROUND_RULES = 4096
#: Slots of the table that finds a round's pairs, as a power of two.
SLOT_BITS = 18


def _marked(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key is in ``chosen`` and the index it has there."""
    slot_of = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    table = np.full(1 << SLOT_BITS, -1, np.int32)
    table[slot_of(chosen)] = np.arange(len(chosen), dtype=np.int32)
    found = table[slot_of(keys)]
    at = np.flatnonzero(found >= 0)
    at = at[chosen[found[at]] == keys[at]]
    return at, found[at]


def _apart(at: np.ndarray) -> np.ndarray:
    """Mask of the positions that stay when neighbouring pairs overlap: every other one of a run."""
    if not len(at):
        return np.zeros(0, bool)
    first = np.append(True, np.diff(at) != 1)
    turn = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return turn % 2 == 0


def compress(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard: ``ids`` of documents that follow one another, ``lengths`` their sizes."""
    base = max(int(ids.max(initial=0)) + 1, 49408)
    wide = base > 61_000
    symbol, key = (np.uint32, np.uint64) if wide else (np.uint16, np.uint32)
    room = (1 << 22) if wide else (1 << 16) - base
    text = ids.astype(symbol)
    rules: list[np.ndarray] = []
    made = 0
    while made < room and len(text) > 1:
        shift = key(8 * text.itemsize)
        keys = (text[:-1].astype(key) << shift) | text[1:]
        ordered = np.sort(keys)
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        counts = np.diff(np.append(heads, len(ordered)))
        often = np.flatnonzero(counts >= MIN_PAIR_COUNT)
        if not len(often):
            break
        size = min(ROUND_RULES, room - made)
        if len(often) > size:
            often = often[np.argpartition(counts[often], len(often) - size)[-size:]]
        chosen = ordered[heads[np.sort(often)]]
        at, rule = _marked(keys, chosen)
        stays = _apart(at)
        at, rule = at[stays], rule[stays]
        used, new = np.unique(rule, return_inverse=True)
        if not len(used):
            break
        rules.append(chosen[used])
        text = text.copy()
        text[at] = (base + made + new).astype(symbol)
        keep = np.ones(len(text), bool)
        keep[at + 1] = False
        text = text[keep]
        made += len(used)
    pairs = np.concatenate(rules) if rules else np.zeros(0, key)
    left, right = (pairs >> key(8 * text.itemsize)).astype(symbol), pairs.astype(symbol)
    sizes = _expansion_lengths(left, right, base)
    begins = np.append(0, np.cumsum(lengths))
    whole = np.append(0, np.cumsum(np.where(text < base, 1, sizes[np.maximum(text.astype(np.int64) - base, 0)] if made else 1)))
    head = _HEADER.pack(_MAGIC, text.itemsize, base, made, len(lengths), len(text))
    return b"".join([head, left.tobytes(), right.tobytes(), sizes.astype("<u4").tobytes(), begins.astype("<u8").tobytes(), whole[:: BLOCK_SYMBOLS].astype("<u8").tobytes(), text.tobytes()])


def _levels(left: np.ndarray, right: np.ndarray, base: int) -> Iterator[slice]:
    """Runs of rules whose symbols are all known when the run begins."""
    newest = np.maximum(left, right).astype(np.int64) - base
    start = 0
    while start < len(newest):
        later = np.flatnonzero(newest[start:] >= start)
        end = start + int(later[0]) if len(later) else len(newest)
        yield slice(start, end)
        start = end


def _expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    sizes = np.ones(base + len(left), np.int64)
    for level in _levels(left, right, base):
        sizes[base:][level] = sizes[left[level]] + sizes[right[level]]
    return sizes[base:]


def _gathered(text: np.ndarray, sizes: np.ndarray, begins: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The expansions of a run of symbols, one after the other."""
    own = sizes[text]
    at = np.repeat(begins[text] - (np.cumsum(own) - own), own)
    at += np.arange(len(at))
    return flat[at]


class Shard:
    """A compressed shard read back; nothing is expanded before it is asked for."""

    def __init__(self, payload: bytes):
        magic, width, self.base, rules, documents, symbols = _HEADER.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        symbol, at = f"<u{width}", _HEADER.size
        parts = []
        for kind, n in ((symbol, rules), (symbol, rules), ("<u4", rules), ("<u8", documents + 1), ("<u8", symbols // BLOCK_SYMBOLS + 1), (symbol, symbols)):
            parts.append(np.frombuffer(payload, kind, n, at))
            at += parts[-1].nbytes
        self.left, self.right, self.sizes, self.begins, self.before, self.text = parts

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(sizes, begins, flat)``: expansions of the shorter symbols, ``TABLE_IDS`` ids in all; size 0 for others."""
        if not hasattr(self, "_short"):
            ordered = np.sort(self.sizes)
            held = int(np.searchsorted(np.cumsum(ordered, dtype=np.int64), TABLE_IDS, "right"))
            # all of one size or none, so that what a held symbol is made of is held too
            self._long = self.sizes >= ordered[held] if held < len(ordered) else np.zeros(len(ordered), bool)
            short = ~self._long
            sizes = np.concatenate([np.ones(self.base, np.int64), np.where(short, self.sizes, 0)])
            begins = np.cumsum(sizes) - sizes
            flat = np.empty(int(sizes.sum()), "<u4")
            flat[: self.base] = np.arange(self.base)
            for level in _levels(self.left, self.right, self.base):
                own = np.arange(level.start, level.stop)[short[level]]
                if len(own):
                    grown = _gathered(np.stack([self.left[own], self.right[own]], 1).ravel(), sizes, begins, flat)
                    at = int(begins[self.base + own[0]])
                    flat[at : at + len(grown)] = grown
            self._short = sizes, begins, flat
        return self._short

    def _expand(self, text: np.ndarray, skip: int, length: int) -> np.ndarray:
        """``length`` ids of a run of symbols, the first ``skip`` left out; long symbols are opened from the top
        down and only where something of them is asked for."""
        short = self._table()
        while True:
            rule = text.astype(np.int64) - self.base
            inner = np.flatnonzero(rule >= 0)
            inner = inner[self._long[rule[inner]]]
            if not len(inner):
                return _gathered(text, *short)[skip : skip + length]
            sizes = short[0][text]
            sizes[inner] = self.sizes[rule[inner]]
            ends = np.cumsum(sizes)
            first, last = int(np.searchsorted(ends, skip, "right")), int(np.searchsorted(ends, skip + length, "left")) + 1
            skip -= int(ends[first - 1]) if first else 0
            text, rule = text[first:last], rule[first:last]
            inner = inner[(inner >= first) & (inner < last)] - first
            times = np.ones(len(text), np.int64)
            times[inner] = 2
            at = inner + np.arange(len(inner))
            text = np.repeat(text, times)
            text[at], text[at + 1] = self.left[rule[inner]], self.right[rule[inner]]

    def ids(self) -> np.ndarray:
        return self._expand(self.text, 0, int(self.begins[-1]))

    def document(self, i: int) -> np.ndarray:
        """The ids of one document; only the symbols that it touches are expanded."""
        start, end = int(self.begins[i]), int(self.begins[i + 1])
        first = max(int(np.searchsorted(self.before, start, "right")) - 1, 0)
        last = int(np.searchsorted(self.before, end, "left"))
        return self._expand(self.text[first * BLOCK_SYMBOLS : last * BLOCK_SYMBOLS], start - int(self.before[first]), end - start)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents in ascending id order and write their shards to ``path``."""
    tail = np.asarray([end_id], "<u4").tobytes()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = source.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = source.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["part", "shard", "start_in_part", "n_tokens", "doc_ids", "payload"]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        state = {"shard": 0, "start": 0}
        keys: list[pa.Array] = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            payload = compress(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64))
            total = sum(map(len, ids)) // 4
            own = pa.concat_arrays(keys)
            columns = [pa.array([part], pa.int32()), pa.array([state["shard"]], pa.int32()), pa.array([state["start"]], pa.int64()), pa.array([total], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([payload], pa.binary())]
            state["shard"] += 1
            state["start"] += total
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        held = 0
        for batch in batches:
            texts, since = batch.column(1), 0
            for i in range(batch.num_rows):
                ids.append(encode(texts[i].as_py()) + tail)
                held += len(ids[-1]) // 4
                if held >= shard_tokens:
                    keys.append(batch.column(0).slice(since, i + 1 - since))
                    since, held = i + 1, 0
                    yield flush()
            if since < batch.num_rows:
                keys.append(batch.column(0).slice(since))
        if ids:
            yield flush()

    ranged.mapInArrow(shards, f"part int, shard int, start_in_part bigint, n_tokens bigint, doc_ids array<{key}>, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an output: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    key = files.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("payload")[i].as_py())
                ids, begins = shard.ids(), shard.begins[:-1].astype(np.int64)
                ends = shard.begins[1:].astype(np.int64)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                keys = batch.column("doc_ids")[i].values
                part, start = batch.column("part")[i].as_py(), batch.column("start_in_part")[i].as_py()
                columns = [keys, pa.array(np.full(len(keys), part, np.int32)), pa.array(begins + start), pa.array(ends - begins), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_own"))
    parts = parts.select("part", (F.sum("_own").over(Window.orderBy("part")) - F.col("_own")).alias("_before"))
    rows = files.select("payload", "doc_ids", "part", "start_in_part").mapInArrow(decode, f"doc_id {key}, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(parts, "part").select("doc_id", (F.col("start_in_part") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def document_ids(spark: SparkSession, path: str, doc_id) -> list[list[int]]:
    """The ids of the documents with this id, each decoded alone."""
    rows = spark.read.parquet(path).filter(F.array_contains("doc_ids", F.lit(doc_id))).select("doc_ids", "payload").toLocalIterator()
    return [Shard(bytes(r["payload"])).document(i).tolist() for r in rows for i, k in enumerate(r["doc_ids"]) if k == doc_id]
