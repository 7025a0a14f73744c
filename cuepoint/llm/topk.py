"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are sorted by id and cut into blocks of a range of ids, each with the largest and smallest
value of every term and a forward index (the block's matrix). A query's best possible score in a
block is the sum over its terms of the larger of the two products with those. Blocks are taken in
the order of that sum, scored through their forward index, and left once the sum falls below the
query's k-th score so far. Scores are whole numbers and computed exactly.

Neighbouring blocks form groups, whose term maxima and minima are the only thing that meets all queries:
first to find each query's most promising group, which is scored and gives a k-th score to start from,
then to send a query, with others of its batch, to the groups whose bound reaches that score. A group that
no query of a batch can gain from is neither sent nor read for it. Within a group blocks are taken in order
of their own bounds. Ties may still displace, so a bound that equals the k-th score counts as reaching.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; shorter vectors count as padded with zeros; rows with the query's id are no candidates for it;
other rows that repeat an id count one by one; a query id that comes several times is answered for
the least of its vectors; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import written

#: Rows of a block, blocks of a group, queries of a batch, groups whose bounds one task works out.
BLOCK_ROWS, GROUP_BLOCKS, BATCH_QUERIES, CHUNK_GROUPS = 512, 16, 1024, 4096


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v)``: usable rows with components floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.filter(usable).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _stored(values: np.ndarray) -> tuple[bytes, str]:
    """A matrix of whole numbers in the fewest bytes a number."""
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= values.min(initial=0) and values.max(initial=0) <= np.iinfo(k).max)
    return values.astype(kind).tobytes(), kind


def _loaded(data: bytes, kind: str, width: int, wanted: int) -> np.ndarray:
    values = np.frombuffer(data, kind).astype(np.int64)
    values = values.reshape(-1, width) if width else np.zeros((len(values), 0), np.int64)
    return np.pad(values, ((0, 0), (0, wanted - width)))


def _blocks(rows: DataFrame) -> DataFrame:
    """Packed blocks of sorted rows: group (of neighbouring blocks), ids, matrix, kind, width, high and low (of its terms)."""
    from pyspark import TaskContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(first, BLOCK_ROWS)
                values = _matrix(own.column("v"))
                data, kind = _stored(values)
                row = {"group": (part << 32) + block // GROUP_BLOCKS, "ids": own.column("vec_id").to_numpy().tobytes(), "matrix": data, "kind": kind, "width": values.shape[1], "high": values.max(0).tobytes(), "low": values.min(0).tobytes()}
                yield pa.RecordBatch.from_pylist([row], _BLOCK_ROW)
                block += 1

    ranged = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    return ranged.mapInArrow(pack, "group bigint, ids binary, matrix binary, kind string, width int, high binary, low binary")


_BLOCK_ROW = pa.schema([("group", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()), ("kind", pa.string()), ("width", pa.int32()), ("high", pa.binary()), ("low", pa.binary())])
_GROUP_ROW = pa.schema([("group", pa.int64()), ("high", pa.binary()), ("low", pa.binary())])
_BATCH_ROW = pa.schema([("batch", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("kind", pa.string()), ("width", pa.int32())])
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _group_bounds(table: pa.Table) -> pa.Table:
    """A group's largest and smallest value of every term; shorter vectors count as padded with zeros."""
    width = max(table.column("width").to_pylist())
    terms = lambda c: np.stack([np.pad(x, (0, width - len(x))) for x in (np.frombuffer(v.as_py(), np.int64) for v in table.column(c))])
    return pa.Table.from_pylist([{"group": table.column("group")[0].as_py(), "high": terms("high").max(0).tobytes(), "low": terms("low").min(0).tobytes()}], _GROUP_ROW)


def _batch(table: pa.Table) -> pa.Table:
    values = _matrix(table.column("v").combine_chunks())
    data, kind = _stored(values)
    return pa.Table.from_pylist([{"batch": table.column("batch")[0].as_py(), "ids": table.column("vec_id").to_numpy().tobytes(), "matrix": data, "kind": kind, "width": values.shape[1]}], _BATCH_ROW)


def _asked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), _loaded(row["matrix"], row["kind"], row["width"], width)


def _bounds(queries: np.ndarray, table: pa.Table) -> np.ndarray:
    """Best possible score of each query in each group, as float64 rounded up or exact int64 sums."""
    high, low = ([np.frombuffer(v.as_py(), np.int64) for v in table.column(c)] for c in ("high", "low"))
    width = max(queries.shape[1], *map(len, high))
    fill = lambda rows: np.stack([np.pad(x, (0, width - len(x))) for x in rows])
    return _best_possible(np.pad(queries, ((0, 0), (0, width - queries.shape[1]))), fill(high), fill(low))


def _exact(q: np.ndarray, largest: int) -> type:
    """float64, whose products and sums are exact up to 2**52, or else int64."""
    return np.float64 if largest * max(1, int(np.abs(q).max(initial=0))) * max(1, q.shape[1]) < 1 << 52 else np.int64


def _best_possible(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    # a term that vectors of a block lack is zero there
    high, low = np.maximum(high, 0), np.minimum(low, 0)
    kind = _exact(q, max(int(high.max(initial=0)), -int(low.min(initial=0))))
    q = q.astype(kind)
    return np.maximum(q, 0) @ high.T.astype(kind) + np.minimum(q, 0) @ low.T.astype(kind)


def search_blocks(queries: tuple[np.ndarray, np.ndarray], blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query index, id, score)`` of every query's k best in these blocks."""
    ids, q = queries
    exact = _exact(q, max([1, *(int(np.abs(m).max(initial=0)) for _, m in blocks)]))
    bounds = _best_possible(q, np.stack([m.max(0) for _, m in blocks]), np.stack([m.min(0) for _, m in blocks])).astype(exact)
    q = q.astype(exact)
    order = np.argsort(-bounds, axis=1, kind="stable")
    row, found, score = (np.zeros(0, t) for t in (np.int64, np.int64, exact))
    kth = np.full(len(ids), -np.inf if exact is np.float64 else np.iinfo(np.int64).min)
    matrices = [m.astype(exact) for _, m in blocks]
    for turn in range(len(blocks)):
        block = order[:, turn]
        open_ = np.flatnonzero(bounds[np.arange(len(ids)), block] >= kth)
        if not len(open_):
            break
        for b in np.unique(block[open_]).tolist():
            own = open_[block[open_] == b]
            scores = q[own] @ matrices[b].T
            allowed = blocks[b][0][None, :] != ids[own][:, None]
            if scores.shape[1] > k:  # no more than k, and those tied with the k-th, can matter
                scored = np.where(allowed, scores, scores.min() - 1)
                least = np.maximum(np.partition(scored, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k], kth[own])
                allowed &= scores >= least[:, None]
            at, col = np.nonzero(allowed)
            row, found, score = np.append(row, own[at]), np.append(found, blocks[b][0][col]), np.append(score, scores[at, col])
        sort = np.lexsort((found, -score, row))
        row, found, score = row[sort], found[sort], score[sort]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        row, found, score, place = row[best], found[best], score[best], place[best]
        full = place == k - 1
        kth[row[full]] = score[full]
    return row, found, score.astype(np.int64)


def _met(batches: DataFrame, cells: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best that the queries of each cell (batch, group, wanted: places in the batch) find in its group."""

    def meet(queries: pa.Table, own: pa.Table) -> pa.Table:
        if not (len(queries) and len(own)):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        row = queries.slice(0, 1).to_pylist()[0]
        width = max([row["width"], *own.column("width").to_pylist()])
        ids, q = _asked(row, width)
        wanted = np.frombuffer(row["wanted"], "<i4")
        ids, q = ids[wanted], q[wanted]
        read = [(np.frombuffer(b["ids"], np.int64), _loaded(b["matrix"], b["kind"], b["width"], width)) for b in own.to_pylist()]
        at, found, score = search_blocks((ids, q), read, k)
        return pa.table({"query_id": ids[at], "vec_id": found, "score": score})

    left = cells.join(batches, "batch").select("batch", "group", "wanted", "ids", "matrix", "kind", "width")
    keys = cells.select(F.col("batch").alias("_b"), F.col("group").alias("_g"))
    right = keys.join(blocks, keys["_g"] == blocks["group"]).select("_b", "_g", "ids", "matrix", "kind", "width")
    return left.groupBy("batch", "group").cogroup(right.groupBy("_b", "_g")).applyInArrow(meet, _FOUND)


def _with_bounds(batches: DataFrame, groups: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel(batch row, table of groups)`` for every batch and every chunk of groups' bounds."""
    count, asks = max(1, -(-groups.count() // CHUNK_GROUPS)), max(1, batches.count())
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = batches.select("*", each(count).alias("chunk"))
    right = groups.select(each(asks).alias("batch"), F.pmod(F.xxhash64("group"), F.lit(count)).cast("int").alias("chunk"), "group", "high", "low")
    run = lambda a, b: kernel(a.slice(0, 1).to_pylist()[0] if len(a) and len(b) else None, b)
    return left.groupBy("batch", "chunk").cogroup(right.groupBy("batch", "chunk")).applyInArrow(run, schema)


def reached(batches: DataFrame, groups: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Cells (batch, group, wanted) whose bounds reach the k-th score that the most promising group gave."""

    def promising(row: dict | None, table: pa.Table) -> pa.Table:
        names = ("batch", "place", "group", "bound")
        if row is None:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        bounds = _bounds(_asked(row, row["width"])[1], table)
        best = bounds.argmax(1)
        values = [np.full(len(best), row["batch"]), np.arange(len(best)), table.column("group").to_numpy()[best], bounds[np.arange(len(best)), best].astype(np.int64)]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(names, values, strict=True)})

    best = _with_bounds(batches, groups, promising, "batch bigint, place bigint, group bigint, bound bigint")
    best = best.groupBy("batch", "place").agg(F.max_by("group", F.struct("bound", "group")).alias("group"))

    def places(table: pa.Table) -> pa.Table:
        return pa.table({"batch": table.column("batch").slice(0, 1).cast(pa.int32()), "group": table.column("group").slice(0, 1), "wanted": pa.array([np.sort(table.column("place").to_numpy()).astype("<i4").tobytes()], pa.binary())})

    cells = best.groupBy("batch", "group").applyInArrow(places, "batch int, group bigint, wanted binary")
    scored = _met(batches, written(cells, "topk-seeds"), blocks, k)
    kth = written(scored.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k), "topk-kth")
    # k-th scores travel with their batch
    known = batches.select("batch", F.explode("query_ids").alias("query_id")).join(kth, "query_id").groupBy("batch").agg(F.collect_list(F.struct("query_id", "kth")).alias("known"))
    names = _BATCH_ROW.names

    def reach(row: dict | None, table: pa.Table) -> pa.Table:
        if row is None:
            return pa.table({"batch": pa.array([], pa.int32()), "group": pa.array([], pa.int64()), "wanted": pa.array([], pa.binary())})
        ids, q = _asked(row, row["width"])
        known = {x["query_id"]: x["kth"] for x in row["known"] or ()}
        least = np.array([known.get(i, np.iinfo(np.int64).min) for i in ids.tolist()], np.int64)
        open_ = _bounds(q, table).astype(np.int64) >= least[:, None]
        groups = np.flatnonzero(open_.any(0)).tolist()
        wanted = [np.flatnonzero(open_[:, g]).astype("<i4").tobytes() for g in groups]
        return pa.table({"batch": pa.array([row["batch"]] * len(groups), pa.int32()), "group": table.column("group").take(pa.array(groups, pa.int64())), "wanted": pa.array(wanted, pa.binary())})

    return _with_bounds(batches.select(*names).join(known, "batch", "left"), groups, reach, "batch int, group bigint, wanted binary")


def prepared(vectors: DataFrame, is_query: Column, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batches of queries, groups' bounds and blocks, written."""
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    asked = written(whole_vectors(vectors.filter(is_query), id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    batch = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // BATCH_QUERIES)))).cast("int")
    dealt = asked.withColumn("batch", batch)
    packed = dealt.groupBy("batch").applyInArrow(_batch, "batch int, ids binary, matrix binary, kind string, width int")
    ids = dealt.groupBy("batch").agg(F.collect_list("vec_id").alias("query_ids"))
    batches = written(packed.join(ids, "batch"), "topk-batches")
    blocks = written(_blocks(rows), "topk-blocks")
    groups = written(blocks.select("group", "width", "high", "low").groupBy("group").applyInArrow(_group_bounds, "group bigint, high binary, low binary"), "topk-groups")
    return batches, groups, blocks


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every row for which ``is_query`` holds."""
    batches, groups, blocks = prepared(vectors, is_query, scale, id_col, vector_col)
    cells = written(reached(batches, groups, blocks, k), "topk-cells")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    near = _met(batches.drop("query_ids"), cells, blocks, k)
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
