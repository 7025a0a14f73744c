"""Repeated passages by sliding sentence spans.

Every run of several consecutive sentences is hashed: from each sentence the shortest run of at least
``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words that begins there, and the shortest that ends there,
so that a passage is covered up to its borders. Hashes are joined globally; a span that has come
before, in a document with a smaller id or earlier in its own, is a repeat, and the sentences under
any repeat are removed. A sentence of at least ``LONG_SENTENCE`` words counts as a span by itself.

A slice of the input sends each hash once, at its first place, and settles its own repeats at once,
so a passage that a third of the corpus shares reaches a task once for each slice and not for each copy.

Cases: null and empty texts have no sentences; a null id comes after all others; of rows with one id
those with another text are other documents, in the order of a hash of their texts, and repeated rows
are one document whose rows get equal results; an empty table gives no rows; other columns are passed on
by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._scratch import written

MIN_SENTENCES, MIN_WORDS, LONG_SENTENCE = 2, 20, 20
#: Spans that a slice gathers before it sends them, and that a bucket's task holds, about.
SLICE_SPANS, BUCKET_SPANS = 500_000, 1_000_000
#: Bytes of text for a span, about; only for the number of buckets.
_BYTES_PER_SPAN = 32
#: Words of runs that are hashed at a time.
RUN_WORDS = 1 << 20

_SPAN = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("first", "<u4"), ("last", "<u4")])
_LAST_ID = (1 << 63) - 1


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes, with the white space behind it) of every sentence and its text.

    A sentence ends behind a run of . ! ? before white space, and at a line break.
    """
    space = T.is_space(data)
    stop = (data == 46) | (data == 33) | (data == 63)
    before = np.zeros(len(data), bool)
    before[1:] = stop[:-1]
    cut = (space & before) | (data == 10)
    inside = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(cut) + 1
    inside[at] = True
    inside[offsets] = True
    starts = np.flatnonzero(inside[:-1])
    ends = np.append(starts[1:], len(data))[: len(starts)]
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=words[1:])
    text = np.searchsorted(offsets, starts, "right") - 1
    # white space alone belongs to the sentence before it, or to none
    real = words[ends] > words[starts]
    starts, text = starts[real], text[real]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends = np.minimum(ends, offsets[text + 1])
    return starts, ends, text


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, first, last)`` of all spans by sentence number within the text, and sentences per text."""
    low = T.lowered(data)
    starts, _, text = sentences(low, offsets)
    word_starts, word_ends, _ = T.words(low, offsets)
    first_word = np.searchsorted(word_starts, starts)
    total = np.append(first_word, len(word_starts))
    number = len(starts)
    per_text = np.bincount(text, minlength=len(offsets) - 1)
    border = np.cumsum(per_text)
    begin, end = (border - per_text)[text], border[text]
    n = np.arange(number)
    # shortest run from each sentence on: enough words and enough sentences
    ahead = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS) - 1, n + MIN_SENTENCES - 1)
    behind = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1, n - MIN_SENTENCES + 1)
    long = np.flatnonzero(np.diff(total) >= LONG_SENTENCE)
    forth, back = np.flatnonzero(ahead < end), np.flatnonzero(behind >= begin)
    pairs = np.concatenate([np.stack([forth, ahead[forth]], 1), np.stack([behind[back], back], 1), np.stack([long, long], 1)])
    code = np.unique(pairs[:, 0] * (number + 1) + pairs[:, 1]) if len(pairs) else np.zeros(0, np.int64)
    first, last = np.divmod(code, number + 1)
    hashes = _runs_of_words(T.run_hashes(low, word_starts, word_ends), total[first], total[last + 1])
    of = text[first]
    return of, hashes, first - begin[first], last - begin[first], per_text


_factors = np.zeros(0, np.uint64)


def _factor(n: int) -> np.ndarray:
    """Odd pseudo-random factors of the first n places."""
    global _factors
    if len(_factors) < n:
        _factors = T.mix(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * T._BASE) | np.uint64(1)
    return _factors[:n]


def _runs_of_words(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of word hashes, which may overlap: each word times a factor of its place in the run."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    upto = np.append(0, np.cumsum(sizes))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + RUN_WORDS, "right")) - 1)
        place = np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], sizes[at:to])
        values = words[np.repeat(starts[at:to], sizes[at:to]) + place] * _factor(int(sizes[at:to].max()))[place]
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        own = upto[at : to + 1] - upto[at]
        out[at:to] = T.mix(total[own[1:]] - total[own[:-1]] + sizes[at:to].astype(np.uint64))
        at = to
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, tie, text)``: a key that orders documents, null ids last, and tells apart texts of one id."""
    return docs.select(keyed_column(id_col, "doc"), tie_column(text_col), F.col(text_col).alias("text"))


def keyed_column(id_col: str, name: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias(name)


def tie_column(text_col: str) -> Column:
    """All 64 bits of a hash of the text, so that texts of one id, or of none, are told apart."""
    return F.xxhash64(text_col).alias("tie")


def bucketed(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Structured rows dealt to buckets by their hash, packed."""
    bucket = ((rows["hash"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(rows) else np.zeros(0, np.int64)
    parts = [x.tobytes() for x in np.split(rows, cuts[1:])] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array([False] * len(parts)), pa.array(parts, pa.binary())], ["bucket", "settled", "part"])


def first_places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first place of their hash, and rows that repeat another place."""
    order = np.lexsort((rows["first"], rows["tie"], rows["doc"], rows["hash"]))
    rows = rows[order]
    head = np.append(True, rows["hash"][1:] != rows["hash"][:-1])
    lead = rows[np.flatnonzero(head)[np.cumsum(head) - 1]]
    same = (rows["doc"] == lead["doc"]) & (rows["tie"] == lead["tie"]) & (rows["first"] == lead["first"])
    return rows[head], rows[~same]


def _settled(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(rows["hash"][0] % np.uint64(buckets))] if len(rows) else [], pa.int32()), pa.array([True] if len(rows) else [], pa.bool_()), pa.array([rows.tobytes()] if len(rows) else [], pa.binary())], ["bucket", "settled", "part"])


def repeated_spans(keys: DataFrame, buckets: int) -> DataFrame:
    """``(doc, tie, spans)``: packed sentence numbers (first, last) of repeated spans."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            firsts, repeats = first_places(np.concatenate(held))
            held.clear()
            yield bucketed(firsts, buckets)
            yield _settled(repeats, buckets)

        for batch in batches:
            docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for row, data, offsets in T.slices(batch.column("text")):
                text, hashes, first, last, _ = spans(data, offsets)
                rows = np.empty(len(text), _SPAN)
                rows["hash"], rows["doc"], rows["tie"], rows["first"], rows["last"] = hashes, docs[row + text], ties[row + text], first, last
                held.append(rows)
                if sum(map(len, held)) >= SLICE_SPANS:
                    yield from flush()
        if held:
            yield from flush()

    def join(table: pa.Table) -> pa.Table:
        settled = table.column("settled").to_numpy(zero_copy_only=False)
        parts = [np.frombuffer(x.as_py(), _SPAN) for x in table.column("part")]
        empty = np.zeros(0, _SPAN)
        _, repeats = first_places(np.concatenate([empty, *(p for p, s in zip(parts, settled, strict=True) if not s)]))
        rows = np.concatenate([repeats, *(p for p, s in zip(parts, settled, strict=True) if s)])
        rows = rows[np.lexsort((rows["tie"], rows["doc"]))]
        heads = np.flatnonzero(np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]))) if len(rows) else np.zeros(0, np.int64)
        packed = [np.stack([x["first"], x["last"]], 1).tobytes() for x in np.split(rows, heads[1:])] if len(rows) else []
        return pa.table({"doc": rows["doc"][heads], "tie": rows["tie"][heads], "spans": pa.array(packed, pa.binary())})

    dealt = keys.mapInArrow(deal, "bucket int, settled boolean, part binary")
    found = dealt.groupBy("bucket").applyInArrow(join, "doc bigint, tie bigint, spans binary")
    return found.groupBy("doc", "tie").agg(F.collect_list("spans").alias("spans"))


def _cleaned(text: str, packed: list[bytes]) -> tuple[str, int, int, int, str]:
    """Text without the repeated sentences; sentences, removed ones, runs of removed ones, their code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = sentences(data, np.array([0, len(data)]))
    change = np.zeros(len(starts) + 1, np.int64)
    for part in packed:
        pairs = np.frombuffer(part, "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1] + 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    if not gone.any():
        return text, len(starts), 0, 0, ""
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    heads, tails = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    cut = [(int(starts[a]), int(ends[b])) for a, b in zip(heads, tails, strict=True)]
    kept, at = [], 0
    for a, b in cut:
        kept.append(data[at:a].tobytes())
        at = b
    kept.append(data[at:].tobytes())
    listed = ",".join(f"{points[a]}:{points[b]}" for a, b in cut)
    return b"".join(kept).decode(), len(starts), int(gone.sum()), len(cut), listed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated sentences removed from the text, and n_sentences, n_removed, n_spans and
    removed_spans (start:end in code points of the old text, comma-joined), in place of columns of these names."""
    keys = keyed(docs, id_col, text_col)
    size = keys.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-int(size) // (_BYTES_PER_SPAN * BUCKET_SPANS)))
    found = written(repeated_spans(keys, buckets), "sentence-spans")
    added = ["n_sentences", "n_removed", "n_spans", "removed_spans"]
    columns = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col]).alias("_row") if len(columns) > 1 else F.lit(None).cast("int").alias("_row"), keyed_column(id_col, "doc"), tie_column(text_col), F.col(text_col).alias("_text"))
    joined = rows.join(found, ["doc", "tie"], "left").select("_row", "_text", "spans")
    row_type = joined.schema["_row"].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for text, packed in zip(batch.column("_text"), batch.column("spans"), strict=True):
                value = text.as_py()
                if value is None:
                    result = (None, 0, 0, 0, "")
                else:
                    result = _cleaned(value, packed.as_py() or [])
                for column, x in zip(out, result, strict=True):
                    column.append(x)
            arrays = [batch.column("_row"), pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", "_text", *added])

    done = joined.mapInArrow(clean, f"_row {row_type}, _text string, n_sentences bigint, n_removed bigint, n_spans bigint, removed_spans string")
    return done.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in columns], *added)
