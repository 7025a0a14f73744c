"""Sequence packing: shortest-pack-first over the length histogram.

Documents are encoded, cut at the capacity and reduced to their lengths. The histogram of lengths
has at most ``capacity`` rows whatever the corpus, so it is the only thing that reaches the driver.
Lengths are placed longest first, always into the packs filled least; the state is counts of
patterns, not packs. Each piece then finds its place by its rank among the pieces of its length.

Cases: a null or empty text is the end id alone; a null ``doc_id`` is kept as it is; repeated rows
are packed as often as they come (equal rows may swap places, which changes no row of the result);
an empty table gives no rows; other columns are ignored. Texts of any length are cut, never shortened.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import written
from ._tokens import encoder

#: Pieces of one length are ranked in groups of about this many rows.
RANK_GROUP_ROWS = 200_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns ``(packs, ((length, times), ...))`` that hold every length of the histogram.

    Each length splits at most one group of packs and opens at most two, so there are at most
    ``3 * capacity`` patterns however many documents are packed.
    """
    groups: list[tuple[int, int, int, tuple[tuple[int, int], ...]]] = []
    serial = 0

    def put(used: int, packs: int, pattern: tuple[tuple[int, int], ...]) -> None:
        nonlocal serial
        if packs:
            serial += 1
            heapq.heappush(groups, (used, serial, packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and groups and groups[0][0] + length <= capacity:
            used, _, packs, pattern = heapq.heappop(groups)
            filled = min(packs, left)
            *before, last = pattern
            more = (*before, (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            put(used + length, filled, more)
            put(used, packs - filled, pattern)
            left -= filled
        fit = capacity // length
        put(fit * length, left // fit, ((length, fit),))
        put(left % fit * length, 1 if left % fit else 0, ((length, left % fit),))
    return [(packs, pattern) for _, _, packs, pattern in sorted(groups)]


def slots(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, np.ndarray]:
    """For each length the rows ``(first rank, first sequence, times in a pack, offset)``, ranks ascending."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            found.setdefault(length, []).append((ranks.get(length, 0), sequence, times, offset))
            ranks[length] = ranks.get(length, 0) + packs * times
            offset += length * times
        sequence += packs
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids cut at ``capacity``: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""
    tail = np.asarray([end_id], "<u4").tobytes()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = source.schema["doc_id"].dataType.simpleString()
    columns = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = f"doc_id {key}, " + ", ".join(f"{c} bigint" for c in columns) + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py()) + tail
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((i, start, len(own) // 4, zlib.crc32(own), total, own if with_ids else None))
            if rows:
                taken, *values = zip(*rows, strict=True)
                arrays = [batch.column(0).take(pa.array(taken, pa.int64()))] + [pa.array(v, pa.int64()) for v in values[:4]]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(values[4], pa.binary())] if with_ids else []), ["doc_id", *columns] + ["ids"] * with_ids)

    return source.mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id`` and ``offset`` (from 0, without gaps)."""
    # a number of the row is written with it, so that copies of one document don't meet in one group of ranks
    numbered = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    cut, total = numbered.drop("_row"), numbered.count()
    groups = max(1, -(-total // RANK_GROUP_ROWS))
    keyed = numbered.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "_row"), F.lit(groups)).cast("int")).drop("_row")
    counts = keyed.groupBy("length", "_group").count()
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(shortest_pack_first(histogram, capacity))

    before = counts.select("length", "_group", (F.sum("count").over(Window.partitionBy("length").orderBy("_group")) - F.col("count")).alias("_before"))
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
    within = F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)) - 1
    ranked = keyed.withColumn("_within", within).join(before, ["length", "_group"])
    ranked = ranked.select(*cut.columns, (F.col("_within") + F.col("_before")).alias("_rank"))
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                rows, own = table[length], np.flatnonzero(lengths == length)
                slot = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
                pack_no, turn = np.divmod(ranks[own] - slot[:, 0], slot[:, 2])
                sequence[own], offset[own] = slot[:, 1] + pack_no, slot[:, 3] + turn * length
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
