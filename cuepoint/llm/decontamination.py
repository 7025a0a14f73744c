"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the documents into shards and writes for each its terms and, for each term, the
sorted places where it comes. A shard holds whole documents, so its lists are complete for them and no
document is gathered from several tasks. ``matches`` sends the test items' windows to every shard in
blocks of a bounded size. There a window's terms are ordered by the length of their lists: places of the
rarest, minus its offset in the window, are the candidates, and each next list, shifted by its own
offset, is intersected with what is left, so a window that lacks one term costs nothing. Terms are
compared as bytes.

A phrase match is a run of ``WINDOW`` consecutive item words in a document; an item of fewer words is one
window. A proximity match has all different words of a window, in any order, within ``SLACK`` words more
than the window is long; phrases that words were put into or moved about in are found by it.

Cases: a null or empty text has no words and no matches; documents are told apart by row, so repeated
rows and ids give a row each; rows of one item id count as one item; an item without an id hits words but
is not listed; an empty table of items leaves all documents clean, one of documents gives no rows; other
columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _terms
from . import _text as T
from ._scratch import written

WINDOW, SLACK = 10, 5
#: Bytes of text in a shard, about; a longer document is one of its own.
SHARD_BYTES = 4 << 20
#: Words of items in a block's row, and bytes of rows that are sent together.
BLOCK_WORDS, BLOCK_BYTES = 1 << 16, 8 << 20
#: Candidates that are held at a time.
CANDIDATES = 1 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_INDEX = "shard bigint, docs array<bigint>, doc_ends binary, terms binary, term_ends binary, list_ends binary, places binary"
_BLOCK = "items array<string>, item_ends binary, codes binary, terms binary, term_ends binary"
_MATCH = "shard bigint, doc int, doc_id bigint, n_words bigint, item_id string, near boolean, runs array<struct<start:int,end:int>>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and how many each text has."""
    low = T.lowered(data)
    inside = _INSIDE[low]
    starts, ends, text = _terms.runs(inside, offsets)
    return _terms.packed(low[inside], np.cumsum(ends - starts)), np.bincount(text, minlength=len(offsets) - 1)


def _bytes(x: np.ndarray) -> bytes:
    return np.asarray(x).astype("<u4").tobytes()


def _shard(name: int, docs: list, words: list[pa.Array], counts: list[np.ndarray]) -> pa.RecordBatch:
    codes, terms = _terms.coded(words)
    order = np.argsort(codes.astype(np.uint16) if len(terms) <= 1 << 16 else codes, kind="stable")
    data, ends = _terms.unpacked(terms)
    lists = np.cumsum(np.bincount(codes, minlength=len(terms)))
    # differences modulo 2**32, which pack well; running sums bring the places back
    gaps = np.diff(order.astype(np.uint32), prepend=np.uint32(0))
    row = [name, docs, _bytes(np.cumsum(np.concatenate(counts))), data, _bytes(ends), _bytes(lists), gaps.astype("<u4").tobytes()]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["shard", "docs", "doc_ends", "terms", "term_ends", "list_ends", "places"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents' positional index: a row for each shard, written to the shared folder."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, words, counts, size = [], [], [], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for row, data, offsets in T.slices(batch.column(1)):
                found, n = _words(data, offsets)
                ids += own[row : row + len(n)]
                words.append(found)
                counts.append(n)
                size += len(data)
                if size >= shard_bytes or len(ids) >= 1 << 16:
                    yield _shard((part << 32) + made, ids, words, counts)
                    made, ids, words, counts, size = made + 1, [], [], [], 0
        if ids:
            yield _shard((part << 32) + made, ids, words, counts)

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return written(plain.mapInArrow(index, _INDEX), "positional-index", compression="zstd")


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> DataFrame:
    """Items' words in rows of a bounded size; long items in pieces that share ``WINDOW - 1`` words."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, data, offsets in T.slices(batch.column(1)):
                found, n = _words(data, offsets)
                codes, terms = _terms.coded([found])
                stop = np.cumsum(n)
                pieces = [(names[row + i], a, min(a + block_words, b)) for i, (b, m) in enumerate(zip(stop.tolist(), n.tolist(), strict=True)) for a in range(b - m, max(b - WINDOW + 1, b - m + (m > 0)), block_words - WINDOW + 1)]
                while pieces:
                    upto = np.cumsum([b - a for _, a, b in pieces])
                    take = max(1, int(np.searchsorted(upto, block_words, "right")))
                    now, pieces = pieces[:take], pieces[take:]
                    own = np.concatenate([codes[a:b] for _, a, b in now])
                    used, own = np.unique(own, return_inverse=True)
                    text, ends = _terms.unpacked(terms.take(pa.array(used)))
                    values = [[x for x, _, _ in now], _bytes(upto[:take]), _bytes(own), text, _bytes(ends)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, [pa.list_(pa.string()), *[pa.binary()] * 4], strict=True)], ["items", "item_ends", "codes", "terms", "term_ends"])

    plain = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return written(plain.mapInArrow(block, _BLOCK), "test-items")


class _Block:
    """Windows of a block: for each its length, its item and where its codes begin."""

    def __init__(self, items: list, item_ends: bytes, codes: bytes, terms: bytes, term_ends: bytes):
        self.items, self.codes = items, np.frombuffer(codes, "<u4").astype(np.int64)
        self.terms = _terms.packed(terms, np.frombuffer(term_ends, "<u4"))
        ends = np.frombuffer(item_ends, "<u4").astype(np.int64)
        sizes = np.diff(ends, prepend=0)
        n = np.where(sizes >= WINDOW, sizes - WINDOW + 1, np.minimum(sizes, 1))
        self.item = np.repeat(np.arange(len(ends)), n)
        self.start = np.arange(len(self.item)) - np.repeat(np.cumsum(n) - n, n) + (ends - sizes)[self.item]
        self.length = np.minimum(sizes, WINDOW)[self.item]


class _Lists:
    """A shard's lists, read for matching."""

    def __init__(self, docs: pa.Scalar, doc_ends: bytes, terms: bytes, term_ends: bytes, list_ends: bytes, places: bytes):
        self.docs = docs
        self.ends = np.frombuffer(doc_ends, "<u4").astype(np.int64)
        self.begins = np.append(0, self.ends[:-1])
        self.terms = _terms.packed(terms, np.frombuffer(term_ends, "<u4"))
        self.stop = np.frombuffer(list_ends, "<u4").astype(np.int64)
        self.size = np.diff(self.stop, prepend=0)
        self.places = np.cumsum(np.frombuffer(places, "<u4"), dtype=np.uint32).astype(np.int64)
        #: term and place in one number, ascending
        self.keys = (np.repeat(np.arange(len(self.size)), self.size) << 32) | self.places

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a term comes at a place."""
        key = (term << 32) | place
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return (self.keys[at] == key) & (place >= 0)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, "right")

    def candidates(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of one term for each window, in bounded pieces: window's row and place."""
        size = self.size[terms]
        upto = np.cumsum(size)
        for low in range(0, int(upto[-1]) if len(upto) else 0, CANDIDATES):
            number = np.arange(low, min(low + CANDIDATES, int(upto[-1])))
            row = np.searchsorted(upto, number, "right")
            yield row, self.places[self.stop[terms[row]] - (upto[row] - number)]

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the matrix of terms and first places where they come one after the other in a document."""
        rank = np.argsort(self.size[terms], axis=1, kind="stable")
        length, found = terms.shape[1], []
        every = np.arange(len(terms))
        for row, place in self.candidates(terms[every, rank[:, 0]]):
            first = place - rank[row, 0]
            for j in range(1, length):
                offset = rank[row, j]
                left = self.holds(terms[row, offset], first + offset)
                row, first = row[left], first[left]
            whole = (first >= 0) & (first + length <= self.ends[np.minimum(self.doc_of(np.maximum(first, 0)), len(self.ends) - 1)])
            found.append((row[whole], first[whole]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def close(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the matrix and starts of spans, ``SLACK`` longer than a row, that hold all its terms."""
        span = terms.shape[1] + SLACK
        rank = np.argsort(self.size[terms], axis=1, kind="stable")
        every, found = np.arange(len(terms)), []
        for row, place in self.candidates(terms[every, rank[:, 0]]):
            doc = self.doc_of(place)
            begin, end = self.begins[doc], self.ends[doc]
            # bit b: the span that starts b words before the rarest term's place holds all terms so far
            open_ = np.full(len(row), (1 << span) - 1, np.int64)
            for j in range(1, terms.shape[1]):
                term = terms[row, rank[row, j]]
                low = np.searchsorted(self.keys, (term << 32) | np.maximum(place - span + 1, begin))
                high = np.searchsorted(self.keys, (term << 32) | np.minimum(place + span, end))
                here = np.zeros(len(row), np.int64)
                for k in range(int((high - low).max()) if len(row) else 0):
                    some = np.flatnonzero(low + k < high)
                    away = place[some] - self.places[low[some] + k]
                    ones = (1 << (span - np.abs(away))) - 1
                    here[some] |= np.where(away >= 0, ones << np.maximum(away, 0), ones)
                open_ &= here
                left = open_ > 0
                row, place, begin, end, open_ = row[left], place[left], begin[left], end[left], open_[left]
            back = np.floor(np.log2(np.maximum(open_ & -open_, 1))).astype(np.int64)
            found.append((row, np.maximum(place - back, begin)))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def match(self, block: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
        """``(document, item, start, end, near)`` of all matches, places within the shard."""
        if not len(self.places) or not len(block.item):
            return
        term = pc.index_in(block.terms, value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)
        own = term[block.codes]
        lacking = np.append(0, np.cumsum(own < 0))
        whole = lacking[block.start + block.length] == lacking[block.start]
        for length in np.unique(block.length[whole]).tolist():
            at = np.flatnonzero(whole & (block.length == length))
            terms = own[block.start[at][:, None] + np.arange(length)]
            row, first = self.phrases(terms)
            yield self.doc_of(first), block.item[at[row]], first, first + length, False
            row, first = self.close(terms)
            doc = self.doc_of(first)
            yield doc, block.item[at[row]], first, np.minimum(first + length + SLACK, self.ends[doc]), True


def _runs(doc: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Overlapping and touching matches of one document and item joined to runs; all are equally long."""
    order = np.lexsort((start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
    head = np.flatnonzero(new | np.append(True, start[1:] > end[:-1]))
    last = np.append(head[1:], len(doc)) - 1
    cuts = np.flatnonzero(new[head])
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(head)).tolist(), strict=True):
        yield int(doc[head[a]]), int(item[head[a]]), start[head[a:b]], end[last[a:b]]


def _matched(lists: _Lists, shard: int, blocks: list[_Block], with_docs: bool) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in range(7)]

    def add(*row):
        for column, x in zip(columns, row, strict=True):
            column.append(x)

    words = (lists.ends - lists.begins).tolist()
    if with_docs:
        for doc, (name, n) in enumerate(zip(lists.docs, words, strict=True)):
            add(shard, doc, name, n, None, False, [])
    for block in blocks:
        for *found, near in lists.match(block):
            if not len(found[0]):
                continue
            for doc, item, start, end in _runs(*found):
                base = lists.begins[doc]
                add(shard, doc, lists.docs[doc], words[doc], block.items[item], near, [{"start": a, "end": b} for a, b in zip((start - base).tolist(), (end - base).tolist(), strict=True)])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    table = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["shard", "doc", "doc_id", "n_words", "item_id", "near", "runs"])
    for at in range(0, len(table), 8192):
        yield table.slice(at, 8192)


def matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document, without an item, and one for each document, item and kind of match, with
    the runs of the document's words that are in one; ``doc`` numbers the documents of a ``shard``."""
    spark = index.sparkSession

    def against(rows: list, first: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [_Block(*r) for r in sent.value]
            for batch in batches:
                for i in range(len(batch)):
                    shard, docs, *rest = (batch.column(k)[i].as_py() for k in range(batch.num_columns))
                    yield from _matched(_Lists(docs, *rest), shard, blocks, first)

        return index.mapInArrow(match, _MATCH)

    found: DataFrame | None = None
    held: list = []
    size = 0
    for row in _blocks(items, id_col, text_col, block_words).toLocalIterator():
        own = sum(len(x) for x in row[1:])
        if held and size + own > block_bytes:
            found = against(held, True) if found is None else found.unionByName(against(held, False))
            held, size = [], 0
        held.append(row)
        size += own
    return against(held, True) if found is None else found.unionByName(against(held, False))


def _covered(runs: Column) -> Column:
    """Words in any of the runs."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(s["upto"], r["start"]))).alias("n"), F.greatest(s["upto"], r["end"]).alias("upto"))
    return F.aggregate(F.array_sort(runs), state, step, lambda s: s["n"])


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document: its words, those in phrase matches and in proximity matches, and the items of both."""
    return summed(matches(build_index(docs, id_col, text_col), items, item_col, item_text_col))


def summed(found: DataFrame) -> DataFrame:
    """The rows of ``matches`` as one for each document."""
    of = lambda near: F.flatten(F.collect_list(F.when(F.col("near") == near, F.col("runs"))))
    names = lambda near: F.array_sort(F.collect_set(F.when(F.col("near") == near, F.col("item_id"))))
    per = found.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), of(False).alias("hit"), names(False).alias("items"), of(True).alias("near"), names(True).alias("near_items"))
    counted = per.select("doc_id", "n_words", _covered(F.col("hit")).alias("n_hit"), "items", _covered(F.col("near")).alias("n_near"), "near_items")
    return counted.withColumn("contaminated", F.col("n_hit") > 0)


def digest(reported: DataFrame) -> DataFrame:
    """Items as their number and a hash of their ids, sorted as strings."""
    listed = F.sha2(F.concat_ws(",", "items"), 256)
    return reported.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), listed.alias("items_sha256"), "contaminated", "n_near", F.size("near_items").cast("bigint").alias("n_near_items"))
