"""Exact removal of repeated byte strings by a sparse, hash-compared suffix sort.

A byte goes if a string of ``SIZE`` bytes that covers it also starts earlier: in a document with a
smaller id, or earlier in its own. Strings are the suffixes of all texts cut to that depth.

1. Anchors: of the ``SIZE - GRAM + 1`` byte grams in a string the one with the least hash is its
   anchor, so equal strings have equal anchors at equal places. Anchors are joined globally; only
   strings whose anchor comes at several places can repeat.
2. Suffixes that share an anchor and their distance to it are sorted in one task by a mergesort that
   compares by prefix polynomial hashes: the common extension is found by binary search and the bytes
   behind it decide. Sorts are stable on the places. Neighbours whose common extension reaches the full
   depth are a run, whose first is its earliest place; the others are repeats once their bytes agree with it.
3. Places are gathered for each document and its bytes are cut.

A slice settles what repeats within it and sends only the first place of everything, in both rounds, so
a string that a third of the corpus shares reaches a task once for each slice and not for each copy.
Around the borders of such a passage strings differ though their anchor is the same. Strings of anchors
that come very often are therefore sent one by one, each with its bytes, and dealt by a hash of the whole
string, not by anchor; they are sorted and compared as all others. Such anchors are a bounded part of all,
so their list is sent to the tasks.

Cases: null and empty texts have no bytes; a null id comes after all others; of rows with one id those
with another text are other documents, in the order of a hash of their texts, and repeated rows are one
document whose rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._scratch import written
from .sentence_dedup import keyed, keyed_column, tie_column

SIZE, GRAM = 100, 50
#: Anchors that a slice gathers and a bucket's task holds, and bytes of context that each holds, about.
SLICE_ANCHORS, BUCKET_ANCHORS, CONTEXT_BYTES = 300_000, 500_000, 3 << 20

#: Anchors with this many places are dealt string by string; there are at most MOST_HOT of them.
HOT_PLACES, MOST_HOT = 4096, 500_000
#: Bytes of one long text that are worked on at a time.
PIECE_BYTES = 4 << 20

_PLACE_BITS = 28
_ANCHOR = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("at", "<u4"), ("places", "<u4")])
_AT = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("at", "<u4")])
_PLACE = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("at", "<u4"), ("end", "<u4")])
_UNIT = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("count", "<u2"), ("back", "<u2")])
_UNITS, _SETTLED = 0, 1
_KNOWN = np.uint32(1 << 31)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first, last, text, hash)``: anchors and the starts of the strings that they stand for."""
    if len(offsets) == 2 and len(data) > PIECE_BYTES + SIZE:  # a string's anchor depends on its own bytes only
        parts = []
        for at in range(0, len(data) - SIZE + 1, PIECE_BYTES):
            own = data[at : at + PIECE_BYTES + SIZE - 1]
            anchor, first, last, text, hashes = anchors(own, np.array([0, len(own)]))
            parts.append((anchor + at, first + at, last + at, text, hashes))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    none = np.zeros(0, np.int64)
    windows = len(data) - SIZE + 1
    if windows <= 0:
        return none, none, none, none, np.zeros(0, np.uint64)
    prefix = T.prefix_hashes(data)
    grams = len(data) - GRAM + 1
    hashes = prefix[GRAM:] - prefix[:grams]
    hashes *= T._inverse_powers(grams)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = hashes & ~low
    least |= np.arange(grams, dtype=np.uint64)
    span, have = SIZE - GRAM + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: have - span], least[span - have :])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:windows]
    start = np.flatnonzero(np.arange(SIZE, windows + SIZE) <= ends)
    if not len(start):
        return none, none, none, none, np.zeros(0, np.uint64)
    anchor = (least[start] & low).astype(np.int64)
    head = np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))
    at = np.flatnonzero(head)
    first, last = start[at], start[np.append(at[1:], len(start)) - 1]
    return anchor[at], first, last, np.searchsorted(offsets, first, "right") - 1, hashes[anchor[at]]


def _full_depth(prefix: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Prefix hashes of suffixes at the full depth of ``SIZE`` bytes."""
    return (prefix[start + SIZE] - prefix[start]) * T._inverse_powers(len(prefix))[start]


def _extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that suffixes from a and from b, which differ in their first ``SIZE``, have in common: binary search on prefix hashes."""
    inverse = T._inverse_powers(len(prefix))
    same, apart = np.zeros(len(a), np.int64), np.full(len(a), SIZE, np.int64)
    while True:  # the common extension is at least same and less than apart
        half = (same + apart) // 2
        if (half == same).all():
            return same
        longer = (prefix[a + half] - prefix[a]) * inverse[a] == (prefix[b + half] - prefix[b]) * inverse[b]
        same, apart = np.where(longer, half, same), np.where(longer, apart, half)


def _compare(data: np.ndarray, prefix: np.ndarray, full: np.ndarray, start: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for suffixes i against j, to the depth of ``SIZE`` bytes."""
    out = np.zeros(len(i), np.int8)
    differ = np.flatnonzero(full[i] != full[j])
    a, b = start[i[differ]], start[j[differ]]
    same = _extension(prefix, a, b)
    out[differ] = np.sign(data[a + same].astype(np.int16) - data[b + same].astype(np.int16))
    return out


def suffix_mergesort(data: np.ndarray, prefix: np.ndarray, full: np.ndarray, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Order that sorts suffixes within each segment, stable; segments lie one after the other.

    All runs of one width are merged at once: an element's place is its own in its run and the number
    of elements of the neighbouring run before it, found by binary search.
    """
    heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    sizes = np.diff(np.append(heads, len(segment)))
    head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    order = np.arange(len(segment))
    width, largest = 1, int(sizes.max(initial=0))
    while width < largest:
        place = np.arange(len(order)) - head
        own = np.flatnonzero(size > width)
        run = place[own] // width
        pair = run // 2 * 2 * width
        sibling = np.where(run % 2 == 0, pair + width, pair)
        low = np.minimum(sibling, size[own])
        first, high = low.copy(), np.minimum(sibling + width, size[own])
        left = run % 2 == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            sign = _compare(data, prefix, full, start, order[head[own[open_]] + middle], order[own[open_]])
            # a left element goes before equal right ones, a right element behind equal left ones
            before = np.where(left[open_], sign < 0, sign <= 0)
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        target = head[own] + pair + (place[own] - run * width) + (low - first)
        merged = order.copy()
        merged[target] = order[own]
        order = merged
        width *= 2
    return order


def _agree(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the ``SIZE`` bytes from a equal those from b."""
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    same = np.ones(len(a), bool)
    for at in [*range(0, SIZE - 7, 8), SIZE - 8]:
        same &= words[a + at] == words[b + at]
    return same


def repeats(units: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For units with their contexts, one after the other: window numbers (over all units) and whether each repeats an earlier place."""
    counts = units["count"].astype(np.int64)
    base = np.cumsum(counts + SIZE - 1) - (counts + SIZE - 1)
    number = np.cumsum(counts) - counts
    total = int(counts.sum())
    flags = np.zeros(total, bool)
    if not total:
        return number, flags
    places = np.lexsort((units["start"], units["tie"], units["doc"]))
    rank = np.empty(len(units), np.int64)
    rank[places] = np.arange(len(units))
    group = np.unique(units["hash"], return_inverse=True)[1]
    each = np.repeat(np.arange(len(units)), counts)
    step = np.arange(total) - number[each]
    away = units["back"].astype(np.int64)[each] - step
    bits = max(1, int(len(units)).bit_length())
    key = (((group[each] << 7) + away) << bits) | rank[each]
    key.sort()
    segment, unit = key >> bits, places[key & ((1 << bits) - 1)]
    away = segment & 127
    several = np.zeros(len(key), bool)
    same = segment[1:] == segment[:-1]
    several[1:] |= same
    several[:-1] |= same
    segment, unit, away = segment[several], unit[several], away[several]
    if not len(segment):
        return number, flags
    step = units["back"].astype(np.int64)[unit] - away
    start = base[unit] + step
    prefix = T.prefix_hashes(data)
    heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    full = _full_depth(prefix, start)
    # segments whose neighbours all agree to the full depth are sorted as they are
    odd = np.append(False, (segment[1:] == segment[:-1]) & (full[1:] != full[:-1]))
    mixed = np.flatnonzero(np.repeat(np.logical_or.reduceat(odd, heads), np.diff(np.append(heads, len(segment)))))
    if len(mixed):
        order = np.arange(len(segment))
        order[mixed] = mixed[suffix_mergesort(data, prefix, full[mixed], start[mixed], segment[mixed])]
        unit, step, start, full = unit[order], step[order], start[order], full[order]
    # in sorted order neighbours whose common extension reaches the full depth are a run
    head = np.append(True, (segment[1:] != segment[:-1]) | (full[1:] != full[:-1]))
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    at = units["start"].astype(np.int64)[unit] + step
    own = (units["doc"][unit] == units["doc"][unit[lead]]) & (units["tie"][unit] == units["tie"][unit[lead]]) & (at == at[lead])
    repeat = ~own
    check = np.flatnonzero(repeat)
    agree = _agree(data, start[check], start[lead[check]])
    if not agree.all():  # the hashes of two strings agree and their bytes don't: compare the whole run
        for k in np.unique(lead[check[~agree]]).tolist():
            firsts: dict[bytes, int] = {}
            for w in np.flatnonzero(lead == k).tolist():
                text = data[start[w] : start[w] + SIZE].tobytes()
                f = firsts.setdefault(text, w)
                repeat[w] = (units["doc"][unit[w]], units["tie"][unit[w]], at[w]) != (units["doc"][unit[f]], units["tie"][unit[f]], at[f])
    flags[number[unit[repeat]] + step[repeat]] = True
    return number, flags


def _cut(units: np.ndarray, number: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Byte ranges of the documents that flagged windows cover."""
    each = np.repeat(np.arange(len(units)), units["count"])
    at = np.flatnonzero(flags)
    if not len(at):
        return np.zeros(0, _PLACE)
    unit = each[at]
    head = np.append(True, (unit[1:] != unit[:-1]) | (at[1:] != at[:-1] + 1))
    first, last = at[head], at[np.append(np.flatnonzero(head)[1:], len(at)) - 1]
    unit = unit[head]
    out = np.empty(len(first), _PLACE)
    out["doc"], out["tie"] = units["doc"][unit], units["tie"][unit]
    out["at"] = units["start"][unit] + (first - number[unit])
    out["end"] = units["start"][unit] + (last - number[unit]) + SIZE
    return out


def _packed(rows: np.ndarray) -> bytes:
    """Rows field by field, compressed."""
    fields = [np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(fields))


def _unpacked(part: bytes, kind: np.dtype) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(part)
    rows, at = np.empty(len(data) // kind.itemsize, kind), 0
    for f in kind.names:
        rows[f] = np.frombuffer(data, kind[f], len(rows), at)
        at += len(rows) * kind[f].itemsize
    return rows


def _cut_by(rows: np.ndarray, to: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Rows parted by ``to``, each part in the order of documents, which packs well."""
    order = np.lexsort((rows["at"], rows["tie"], rows["doc"], to))
    rows, to = rows[order], to[order]
    cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    return to[cuts].tolist(), np.split(rows, cuts[1:]) if len(to) else []


def _by_document(rows: np.ndarray, fields: list[str]) -> pa.Table:
    rows = rows[np.lexsort((rows["tie"], rows["doc"]))]
    heads = np.flatnonzero(np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]))) if len(rows) else np.zeros(0, np.int64)
    packed = [np.stack([x[f] for f in fields], 1).tobytes() for x in np.split(rows, heads[1:])] if len(rows) else []
    return pa.table({"doc": rows["doc"][heads], "tie": rows["tie"][heads], "packed": pa.array(packed, pa.binary())})


def _to_documents(rows: np.ndarray, targets: int) -> pa.Table:
    """Rows packed by where their documents are gathered: few rows to send, however many documents there are."""
    key = T.mix(rows["doc"].view(np.uint64) ^ rows["tie"].view(np.uint64)) if len(rows) else np.zeros(0, np.uint64)
    to, parts = _cut_by(rows, (key % np.uint64(targets)).astype(np.int64))
    return pa.table({"to": pa.array(to, pa.int32()), "n": pa.array([len(x) for x in parts], pa.int64()), "part": pa.array(map(_packed, parts), pa.binary())})


def _gathered_documents(sent: DataFrame, kind: np.dtype, fields: list[str]) -> DataFrame:
    """``(doc, tie, packed)``: one row a document."""

    def gather(table: pa.Table) -> pa.Table:
        return _by_document(np.concatenate([_unpacked(x.as_py(), kind) for x in table.column("part")]), fields)

    return sent.select("to", "part").groupBy("to").applyInArrow(gather, "doc bigint, tie bigint, packed binary")


def _sent(buckets: list[int], kind: int, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["bucket", "kind", "part"])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((T.mix(hashes) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _met(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors sorted so that equal ones meet, and whether each has another place."""
    rows = rows[np.lexsort((rows["at"] & ~_KNOWN, rows["tie"], rows["doc"], rows["hash"]))]
    if not len(rows):
        return rows, np.zeros(0, bool)
    head = np.append(True, rows["hash"][1:] != rows["hash"][:-1])
    heads = np.flatnonzero(head)
    first = rows[heads[np.cumsum(head) - 1]]
    other = (rows["doc"] != first["doc"]) | (rows["tie"] != first["tie"]) | ((rows["at"] & ~_KNOWN) != (first["at"] & ~_KNOWN))
    return rows, np.repeat(np.logical_or.reduceat(other, heads), np.diff(np.append(heads, len(rows))))


def repeated_anchors(keys: DataFrame, buckets: int, hot_places: int) -> DataFrame:
    """Packed places (``to``, ``n``, ``part``) of anchors that come at several places; and ``hot``: anchors that come at very many."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows, several = _met(np.concatenate(held))
            held.clear()
            if not len(rows):
                return
            if several.any():
                yield _sent([int(rows["doc"][0] % buckets)], _SETTLED, [_packed(rows[several][["doc", "tie", "at"]].astype(_AT))])
            head = np.append(True, rows["hash"][1:] != rows["hash"][:-1])
            firsts = rows[head].copy()
            firsts["at"] |= np.where(several[head], _KNOWN, np.uint32(0))
            firsts["places"] = np.diff(np.append(np.flatnonzero(head), len(rows)))
            to, parts = _cut_by(firsts, _bucket(firsts["hash"], buckets))
            yield _sent(to, _UNITS, [_packed(x) for x in parts])

        for batch in batches:
            docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for row, data, offsets in T.slices(batch.column("text")):
                anchor, _, _, text, hashes = anchors(data, offsets)
                rows = np.empty(len(anchor), _ANCHOR)
                rows["hash"], rows["doc"], rows["tie"], rows["at"] = hashes, docs[row + text], ties[row + text], anchor - offsets[text]
                rows["places"] = 1
                held.append(rows)
                if sum(map(len, held)) >= SLICE_ANCHORS:
                    yield from flush()
        if held:
            yield from flush()

    def join(table: pa.Table) -> pa.Table:
        sent = list(zip(table.column("kind").to_pylist(), table.column("part"), strict=True))
        rows, several = _met(np.concatenate([np.zeros(0, _ANCHOR), *(_unpacked(p.as_py(), _ANCHOR) for k, p in sent if k == _UNITS)]))
        new = rows[several & ((rows["at"] & _KNOWN) == 0)][["doc", "tie", "at"]].astype(_AT)
        found = _to_documents(np.concatenate([new, *(_unpacked(p.as_py(), _AT) for k, p in sent if k == _SETTLED)]), buckets)
        heads = np.flatnonzero(np.append(True, rows["hash"][1:] != rows["hash"][:-1])) if len(rows) else np.zeros(0, np.int64)
        places = np.add.reduceat(rows["places"].astype(np.int64), heads) if len(rows) else heads
        hot = rows["hash"][heads][places >= hot_places].view(np.int64)
        more = pa.table({"to": pa.nulls(len(hot), pa.int32()), "n": pa.nulls(len(hot), pa.int64()), "part": pa.nulls(len(hot), pa.binary()), "hot": pa.array(hot)})
        return pa.concat_tables([found.append_column("hot", pa.nulls(len(found), pa.int64())), more])

    dealt = keys.mapInArrow(deal, "bucket int, kind int, part binary")
    return dealt.groupBy("bucket").applyInArrow(join, "to int, n bigint, part binary, hot bigint")


def _gathered(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return data[at]


def _packed_units(units: np.ndarray, data: np.ndarray) -> bytes:
    """Units and their contexts; compressed, as contexts are most of what is shuffled."""
    return zstandard.ZstdCompressor(level=1).compress(np.uint64(len(units)).tobytes() + units.tobytes() + data.tobytes())


def _unpacked_units(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    part = zstandard.ZstdDecompressor().decompress(part)
    n = int(np.frombuffer(part, "<u8", 1)[0])
    return np.frombuffer(part, _UNIT, n, 8), np.frombuffer(part, np.uint8, offset=8 + n * _UNIT.itemsize)


def _singles(units: np.ndarray, data: np.ndarray, number: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted windows as units of their own, named by the hash of their bytes, and where their bytes begin."""
    counts = units["count"].astype(np.int64)
    base = np.cumsum(counts + SIZE - 1) - (counts + SIZE - 1)
    at = np.flatnonzero(wanted)
    unit = np.repeat(np.arange(len(units)), counts)[at]
    step = at - number[unit]
    begin = base[unit] + step
    out = units[unit].copy()
    out["hash"] = T.span_hashes(T.prefix_hashes(data), begin, begin + SIZE)
    out["start"] += step.astype(np.uint32)
    out["count"], out["back"] = 1, 0
    return out, begin


def covered(marked: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """``(doc, tie, packed)``: byte ranges to remove, from documents with their repeated anchors. ``hot``: sorted hashes of anchors dealt string by string."""
    shared = marked.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            units, data = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            number, flags = repeats(units, data)
            done = _cut(units, number, flags)
            if len(done):
                yield _sent([int(units["doc"][0] % buckets)], _SETTLED, [_packed(done)])
            often = np.repeat(np.isin(units["hash"], shared.value), units["count"])
            single, own = _singles(units, data, number, ~flags & often)
            flags = flags | often
            # what is left of each unit: from its first to its last window that is not settled
            counts = units["count"].astype(np.int64)
            open_ = np.flatnonzero(~flags)
            unit = np.repeat(np.arange(len(units)), counts)[open_]
            head = np.append(True, unit[1:] != unit[:-1])[: len(unit)]
            first, last = open_[head], open_[np.append(np.flatnonzero(head)[1:], len(open_))[: head.sum()] - 1]
            unit = unit[head]
            skip = first - number[unit]
            base = np.cumsum(counts + SIZE - 1) - (counts + SIZE - 1)
            left = units[unit].copy()
            left["start"] += skip.astype(np.uint32)
            left["back"] -= skip.astype(np.uint16)
            left["count"] = last - first + 1
            begin, size = np.append(base[unit] + skip, own), np.append(last - first + SIZE, np.full(len(own), SIZE))
            left = np.append(left, single)
            if not len(left):
                return
            to = _bucket(left["hash"], buckets)
            order = np.argsort(to, kind="stable")
            left, begin, size, to = left[order], begin[order], size[order], to[order]
            cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
            parts = [_packed_units(left[a:b], _gathered(data, begin[a:b], size[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield _sent(to[cuts[:-1]].tolist(), _UNITS, parts)

        for batch in batches:
            docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            packed = batch.column("packed")
            for row, data, offsets in T.slices(batch.column("text")):
                anchor, first, last, text, hashes = anchors(data, offsets)
                wanted = [np.frombuffer(packed[row + i].as_py(), "<u4") for i in range(len(offsets) - 1)]
                places = np.sort(np.concatenate([np.zeros(0, np.int64), *(w.astype(np.int64) + offsets[i] for i, w in enumerate(wanted))]))
                own = np.isin(anchor, places)
                anchor, first, last, text, hashes = (x[own] for x in (anchor, first, last, text, hashes))
                units = np.empty(len(anchor), _UNIT)
                units["hash"], units["doc"], units["tie"] = hashes, docs[row + text], ties[row + text]
                units["start"], units["count"], units["back"] = first - offsets[text], last - first + 1, anchor - first
                for a in range(0, len(units), 20_000):
                    b = min(len(units), a + 20_000)
                    held.append((units[a:b], _gathered(data, first[a:b], last[a:b] - first[a:b] + SIZE)))
                    if sum(len(x[1]) for x in held) >= CONTEXT_BYTES:
                        yield from flush()
        if held:
            yield from flush()

    def join(table: pa.Table) -> pa.Table:
        done, units, data = [np.zeros(0, _PLACE)], [np.zeros(0, _UNIT)], [np.zeros(0, np.uint8)]
        for part, kind in zip(table.column("part"), table.column("kind").to_pylist(), strict=True):
            if kind == _SETTLED:
                done.append(_unpacked(part.as_py(), _PLACE))
            else:
                own = _unpacked_units(part.as_py())
                units.append(own[0])
                data.append(own[1])
        units, data = np.concatenate(units), np.concatenate(data)
        return _to_documents(np.concatenate([*done, _cut(units, *repeats(units, data))]), buckets)

    dealt = marked.mapInArrow(deal, "bucket int, kind int, part binary")
    found = dealt.groupBy("bucket").applyInArrow(join, "to int, n bigint, part binary")
    return _gathered_documents(found, _PLACE, ["at", "end"])


def _kept(data: bytes, packed: bytes) -> tuple[bytes, int, list[tuple[int, int]]]:
    """Bytes that stay, how many go, and the maximal removed runs."""
    ranges = np.frombuffer(packed, "<u4").reshape(-1, 2).astype(np.int64)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    head = np.append(True, ranges[1:, 0] > reach[:-1])
    runs = list(zip(ranges[head, 0].tolist(), reach[np.append(np.flatnonzero(head)[1:], len(ranges)) - 1].tolist(), strict=True))
    borders = [0, *(x for run in runs for x in run), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
    return kept, len(data) - len(kept), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, kept (the bytes that stay), removed (start and end of runs)."""
    keys = keyed(docs, id_col, text_col)
    size = int(keys.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    per_anchor = (SIZE - GRAM + 2) / 2
    total = int(size / per_anchor)
    found = written(repeated_anchors(keys, max(1, -(-total // BUCKET_ANCHORS)), max(HOT_PLACES, total // MOST_HOT)), "suffix-anchors")
    hot = np.sort(found.filter("hot is not null").select("hot").distinct().toArrow().column("hot").to_numpy().view(np.uint64))
    places = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marked = _gathered_documents(found.filter("part is not null"), _AT, ["at"])
    cover = written(covered(keys.join(marked, ["doc", "tie"]), max(1, -(-int(places * (per_anchor + SIZE)) // CONTEXT_BYTES)), hot), "suffix-cover")

    rows = docs.select(F.col(id_col).alias("doc_id"), keyed_column(id_col, "doc"), tie_column(text_col), F.col(text_col).alias("_text"))
    last = rows.join(cover, ["doc", "tie"], "left").select("doc_id", F.coalesce("_text", F.lit("")).alias("_text"), "packed")
    key = last.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept, runs = [], [], [], []
            for text, packed in zip(batch.column("_text"), batch.column("packed"), strict=True):
                data = text.as_buffer().to_pybytes()
                own = _kept(data, packed.as_py()) if packed.is_valid else (data, 0, [])
                sizes.append(len(data))
                kept.append(own[0])
                removed.append(own[1])
                runs.append([{"start": a, "end": b} for a, b in own[2]])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, span)], ["doc_id", "n_bytes", "n_removed", "kept", "removed"])

    return last.mapInArrow(cut, f"doc_id {key}, n_bytes bigint, n_removed bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
