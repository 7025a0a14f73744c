"""Vector top-k over two indexes, weighted union, time dedup, dynamic k, and their compositions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import strip
from .folds import anchored_best

#: Queries that are sent to all tasks, at most.
QUERY_BLOCK = 4096
#: Blocks of queries whose best similarities a task keeps.
_REMEMBERED = 64
#: More queries are dealt to cells of this many times ``QUERY_BLOCK``, or fewer whose vectors have ``CELL_BYTES``,
#: and of about so many rows of the index.
CELL_BLOCKS, CELL_BYTES, CELL_ROWS = 16, 48 << 20, 1 << 17
#: Similarities that are made at a time, rows found that a cell holds at least before it sorts them out, and their bytes.
_SIMS, _HELD, _HELD_BYTES = 1 << 21, 1 << 20, 64 << 20
#: Rows of a batch that give a cell's first bounds.
_FIRST = 2048


def _best(group: np.ndarray, sims: np.ndarray, k: int, ids: pa.Array) -> np.ndarray:
    """Rows with the ``k`` highest similarities of each group; ids are compared only where more are tied."""
    order = np.lexsort((-sims, group))
    grouped, high = group[order], sims[order]
    first, last = np.searchsorted(grouped, grouped), np.searchsorted(grouped, grouped, "right") - 1
    kept = order[high >= high[np.minimum(first + k - 1, last)]]
    heads = np.flatnonzero(first == np.arange(len(first)))
    if len(kept) > int(np.minimum(last[heads] - first[heads] + 1, k).sum()):
        names = ids.take(pa.array(kept)).to_pylist()
        again = sorted(range(len(kept)), key=lambda i: (group[kept[i]], -sims[kept[i]], names[i]))
        kept = kept[again]
        kept = kept[np.arange(len(kept)) - np.searchsorted(group[kept], group[kept]) < k]
    return kept


def _packed(index: DataFrame, own: str | None) -> DataFrame:
    """A row for each Arrow batch of ``index`` (and value of ``own``), with the batch's rows as an array."""
    names = index.columns
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in index.schema.fields)
    kind = index.schema[own].dataType.simpleString() if own else "int"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(names.index(own)).dictionary_encode() if own else None
            for k in range(len(values.dictionary) if own else 1):
                rows = batch.filter(pc.fill_null(pc.equal(values.indices, k), False)) if own else batch
                if len(rows):
                    one = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.StructArray.from_arrays(rows.columns, names))
                    yield pa.RecordBatch.from_arrays([values.dictionary.slice(k, 1) if own else pa.array([0], pa.int32()), one], ["_own", "_rows"])

    return index.mapInArrow(pack, f"_own {kind}, _rows array<struct<{fields}>>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros behind."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths > width).any():
        raise ValueError("index and query vectors differ in length")
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return out


def _groups(rows: pa.StructArray, keys: list[str]) -> np.ndarray:
    """A number for each combination of the keys' values."""
    group = np.zeros(len(rows), np.int64)
    for key in keys:
        codes = np.nan_to_num(rows.field(key).dictionary_encode().indices.to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
        group = group * (int(codes.max(initial=0)) + 2) + codes + 1
    return group - group.min(initial=0)


def _scored(met: DataFrame, columns: list[str], schema: str, keys: list[str], k: int, vector: str, id_col: str) -> DataFrame:
    """Rows of each batch that may be among the ``k`` nearest of a query that it meets, with query_id and sim.

    A task remembers each query's k best so far; of later batches only what reaches the k-th goes on.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                asked, rows = batch.column(2).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                rows = rows.filter(rows.field(vector).is_valid())
                if not len(rows):
                    continue
                queries = asked.field("vector")
                width = int(np.diff(queries.offsets.to_numpy()).max())
                sims = _matrix(rows.field(vector), width) @ _matrix(queries, width).T
                group, ids = _groups(rows, keys), rows.field(id_col)
                names = asked.field("query_id")
                near = np.ones(sims.shape, bool)
                if not keys:
                    block = (batch.column(0)[i].as_py(), *names.to_pylist())
                    if len(known) >= _REMEMBERED and block not in known:
                        known.clear()
                    both = np.concatenate([known.get(block, np.full((k, len(names)), -np.inf)), sims])
                    # the k highest, the least of them first
                    known[block] = np.sort(np.partition(both, len(both) - k, axis=0)[len(both) - k :], axis=0)
                    near = sims >= known[block][0]
                found = []
                for j in np.flatnonzero(near.any(axis=0)).tolist():
                    at = np.flatnonzero(near[:, j])
                    if len(at) > k:
                        at = at[_best(group[at], sims[at, j], k, ids.take(pa.array(at)))]
                    found.append((at, np.full(len(at), j), sims[at, j]))
                if found:
                    at, query, sim = (np.concatenate(x) for x in zip(*found, strict=True))
                    own = rows.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*(own.field(c) for c in columns), names.take(pa.array(query)), pa.array(sim)], [*columns, "query_id", "sim"])

    return met.select("_own", "_rows", "_asked").mapInArrow(score, schema)


def _marked(flags: np.ndarray) -> np.ndarray:
    """Places of the true ones, few among many: eight are looked at at once, so there are a multiple of eight."""
    words = np.flatnonzero(flags.view(np.uint64))
    at, place = np.nonzero(flags.reshape(-1, 8)[words])
    return words[at] * 8 + place


class _Cell:
    """The ``k`` best rows of a cell for each of its queries: rows come sorted by ``keys``, one group after the other."""

    def __init__(self, keys: list[str], k: int, id_col: str, columns: list[str]):
        self.keys, self.k, self.id_col, self.columns = keys, k, id_col, columns
        self.names: list[pa.Array] = []
        self.vectors: list[pa.Array] = []
        self.matrix: np.ndarray | None = None
        self.group, self.number = None, -1
        self.held: list[tuple] = []
        self.count = self.bytes = 0
        self.rooms: dict[type, np.ndarray] = {}

    def _room(self, kind: type, size: int) -> np.ndarray:
        """Room for ``size`` numbers that are made anew for each step; what it holds is of the step before."""
        if len(self.rooms.get(kind, ())) < size:
            self.rooms[kind] = np.empty(size, kind)
        return self.rooms[kind][:size]

    def ask(self, names: pa.Array, vectors: pa.Array) -> None:
        self.names.append(names)
        self.vectors.append(vectors)

    def _begin(self) -> None:
        names, vectors = pa.concat_arrays(self.names), pa.concat_arrays(self.vectors)
        self.vectors, self.asked = [], names
        self.matrix = _matrix(vectors, int(pc.max(pc.list_value_length(vectors)).as_py()))
        self.length = np.linalg.norm(self.matrix, axis=1)
        self.small = self.matrix.astype(np.float32) if np.abs(self.matrix).max(initial=0) < 1e15 else None
        self.limit = max(_HELD, 2 * len(names) * self.k)

    def meet(self, rows: pa.StructArray, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
        if not self.names:
            return
        if self.matrix is None:
            self._begin()
        values = list(zip(*(["nan" if v != v else v for v in rows.field(c).to_pylist()] for c in self.keys), strict=True)) or [()] * len(rows)
        cuts = [0] + [i for i in range(1, len(values)) if values[i] != values[i - 1]] + [len(values)]
        x = _matrix(vectors, self.matrix.shape[1])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if self.number < 0 or values[a] != self.group:
                self.group, self.number = values[a], self.number + 1
                self.least = np.full(len(self.asked), -np.inf)
            yield from self._score(rows.slice(a, b - a), x[a:b])

    def _score(self, rows: pa.StructArray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Similarities in single precision, less what they may be off, leave out what can't be among the best."""
        n, width = x.shape
        single = self.small is not None and np.abs(x).max(initial=0) < 1e15
        left, right = (x.astype(np.float32), self.small) if single else (x, self.matrix)
        kind = left.dtype.type
        norms = np.linalg.norm(x, axis=1)
        longest = norms[np.isfinite(norms)].max(initial=0)
        off = (width + 4) * (float(np.finfo(kind).eps) * longest * self.length + float(np.finfo(kind).tiny) * (1 + longest + self.length))
        step = max(1, _SIMS // n)
        for a in range(0, len(self.asked), step):
            own = slice(a, a + step)
            some = right[own]
            size = n * len(some)
            sims = np.matmul(left, some.T, out=self._room(kind, size).reshape(n, len(some)))
            if n >= self.k and np.isneginf(self.least[own]).any():
                # the k-th of some rows is a bound too; NaN is above all numbers
                few = min(n, max(self.k, _FIRST))
                first = np.partition(sims[:few], few - self.k, axis=0)[few - self.k].astype(np.float64) - off[own]
                self.least[own] = np.fmax(self.least[own], first)
            floor = np.nextafter((self.least[own] - off[own]).astype(kind), kind(-np.inf))
            flags = self._room(np.bool_, size + -size % 8)
            flags[size:] = False
            near = flags[:size].reshape(sims.shape)
            np.logical_not(np.less(sims, floor, out=near), out=near)
            at, query = np.divmod(_marked(flags), sims.shape[1])
            if len(at):
                # a small slice is found whole by all queries: so many terms at a time as similarities
                part = max(1, _SIMS // max(1, width))
                sim = np.concatenate([(x[at[i : i + part]] * self.matrix[a + query[i : i + part]]).sum(axis=1) for i in range(0, len(at), part)])
                on = np.flatnonzero(~(sim < self.least[a + query]))
                found = rows.take(pa.array(at[on]))
                self.held.append((np.full(len(on), self.number), a + query[on], sim[on], found))
                self.count, self.bytes = self.count + len(on), self.bytes + found.nbytes
            if self.count > self.limit or self.bytes > _HELD_BYTES:
                self._sort_out()
                if 2 * self.count > self.limit or 2 * self.bytes > _HELD_BYTES:
                    yield from self.end()

    def _sort_out(self) -> None:
        """Only the best of what is held stays; ties go to the smaller id."""
        group, query, sim = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        rows = pa.concat_arrays([h[3] for h in self.held])
        high = np.where(np.isnan(sim), np.inf, sim)
        one = group * len(self.asked) + query
        order = np.lexsort((-high, one))
        head = np.append(True, one[order[1:]] != one[order[:-1]])
        heads = np.flatnonzero(head)
        size = np.diff(np.append(heads, len(order)))
        least = high[order[heads + np.minimum(size, self.k) - 1]]
        kept = order[high[order] >= np.repeat(least, size)]
        if len(kept) > int(np.minimum(size, self.k).sum()):
            tied = pa.table({"one": one[kept], "low": -high[kept], "id": rows.field(self.id_col).take(pa.array(kept))})
            kept = kept[pc.sort_indices(tied, [("one", "ascending"), ("low", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()]
            starts = np.flatnonzero(np.append(True, one[kept[1:]] != one[kept[:-1]]))
            kept = kept[np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept)))) < self.k]
        now = heads[(size >= self.k) & (group[order[heads]] == self.number)]
        asked = query[order[now]]
        self.least[asked] = np.fmax(self.least[asked], high[order[now + self.k - 1]])
        rows = rows.take(pa.array(kept))
        self.held = [(group[kept], query[kept], sim[kept], rows)]
        self.count, self.bytes = len(kept), rows.nbytes

    def end(self) -> Iterator[pa.RecordBatch]:
        """What is held goes on."""
        if self.count:
            self._sort_out()
            _, query, sim, rows = self.held[0]
            for at in range(0, len(query), 1 << 15):
                own = rows.slice(at, 1 << 15).flatten()
                names = self.asked.take(pa.array(query[at : at + (1 << 15)]))
                yield pa.RecordBatch.from_arrays([*own, names, pa.array(sim[at : at + (1 << 15)])], [*self.columns, "query_id", "sim"])
        self.held, self.count, self.bytes = [], 0, 0


def _in_cells(index: DataFrame, given: DataFrame, columns: list[str], schema: str, keys: list[str], k: int, vector: str, id_col: str, own: str | None, per_cell: int) -> DataFrame:
    """The best rows of each cell of queries and rows. A cell's rows pass by its queries batch by batch, and only the best are held.

    Rows are shuffled once for each cell's worth of queries that there are (of their own value), queries once for each of rows.
    With ``keys`` a cell has few of their values, each whole or in parts of about ``CELL_ROWS``: every value in a cell costs ``k`` rows a query.
    """
    spark = index.sparkSession
    rows = index.filter(F.col(vector).isNotNull()).withColumn("_own", F.col(own) if own else F.lit(0))
    cut = lambda n, size: F.ceil(n / size).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if own:
        asked, held = (t.groupBy("_own").agg(F.count("*").alias("n")) for t in (given, rows))
        sizes = asked.select("_own", cut(F.col("n"), per_cell).alias("_blocks")).join(held.select("_own", cut(F.col("n"), CELL_ROWS).alias("_parts")), "_own")
        given, rows = given.join(sizes, "_own"), rows.join(sizes, "_own")
    else:
        blocks, parts = max(1, -(-given.count() // per_cell)), max(1, -(-rows.count() // CELL_ROWS))
        given, rows = (t.withColumn("_blocks", F.lit(blocks)).withColumn("_parts", F.lit(parts)) for t in (given, rows))
    within = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(n)).cast("int")
    part = within(id_col, "_parts", 2)
    if keys and not own:
        # values with more rows than a cell: as many as there are cells of rows, at most
        rows = rows.withColumn("_value", F.xxhash64(*keys, F.lit(3)))
        large = rows.groupBy("_value").agg(cut(F.count("*"), CELL_ROWS).alias("_cuts")).filter("_cuts > 1")
        rows = rows.join(F.broadcast(large), "_value", "left").fillna(1, ["_cuts"])
        part = F.pmod(F.pmod("_value", F.col("_parts")) + within(id_col, "_cuts", 2), F.col("_parts")).cast("int")
    asks = given.select("_own", within("query_id", "_blocks", 1).alias("_block"), every(F.col("_parts")).alias("_part"), F.lit(0).alias("_side"), "query_id", F.col("vector").alias("_asked"))
    held = rows.select("_own", every(F.col("_blocks")).alias("_block"), part.alias("_part"), F.lit(1).alias("_side"), F.col(vector).alias("_vector"), F.struct(*columns).alias("_row"))
    met = asks.unionByName(held, allowMissingColumns=True)
    cell = ["_own", "_block", "_part"]
    cells = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *cell)
    met = cells.sortWithinPartitions(*cell, "_side", *(F.col("_row")[c] for c in keys)).select(*cell, "_side", "query_id", "_asked", "_vector", "_row")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            coded = np.column_stack([*(batch.column(i).dictionary_encode().indices.to_numpy() for i in range(3)), batch.column(3).to_numpy()])
            cuts = [0, *(np.flatnonzero((coded[1:] != coded[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(batch.column(i)[a].as_py() for i in range(3))
                if state is None or key != now:
                    if state:
                        yield from state.end()
                    now, state = key, _Cell(keys, k, id_col, columns)
                if coded[a, 3]:
                    yield from state.meet(batch.column(7).slice(a, b - a), batch.column(6).slice(a, b - a))
                else:
                    state.ask(batch.column(4).slice(a, b - a), batch.column(5).slice(a, b - a))
        if state:
            yield from state.end()

    return met.mapInArrow(score, schema)


def asked(queries: DataFrame, text: str = "query") -> DataFrame:
    """Queries that aren't blank."""
    return queries.filter(strip(F.coalesce(F.col(text), F.lit(""))) != "")


def candidates(index: DataFrame, queries: DataFrame, k: int = 10, keys: list[str] | None = None, vector: str = "embedding", id_col: str = "id", keep_self: bool = True, own: str | None = None) -> DataFrame:
    """Rows that may be among the ``k`` nearest to a query (query_id, vector), with query_id and sim.

    Up to ``QUERY_BLOCK`` queries are sent to all tasks, and each batch of the index gives its best. More are dealt
    to cells, each of a bounded number of queries and a part of the index, which is shuffled to them; a cell gives
    its best, so nothing is held whole. With ``own``, a column of both, a query meets the rows with its value only.
    """
    keys = keys or []
    columns = [c for c in index.columns if c != vector]
    value = F.col(own) if own else F.lit(0)
    given = queries.select(value.alias("_own"), "query_id", "vector").filter("vector is not null")
    n, width = given.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.select(*columns).schema.fields)
    schema = f"{fields}, query_id {queries.schema['query_id'].dataType.simpleString()}, sim double"
    k += 0 if keep_self else 1
    if n <= QUERY_BLOCK:
        asked = given.withColumn("vector", F.col("vector").cast("array<double>")).groupBy("_own").agg(F.collect_list(F.struct("query_id", "vector")).alias("_asked"))
        if own:
            index = index.join(given.select(F.col("_own").alias(own)).distinct(), own, "left_semi")
        met = _packed(index.select(*columns, vector), own).join(F.broadcast(asked), "_own")
        out = _scored(met, columns, schema, keys, k, vector, id_col)
    else:
        per_cell = max(1, min(CELL_BLOCKS * QUERY_BLOCK, CELL_BYTES // (12 * max(1, width))))
        out = _in_cells(index, given, columns, schema, keys, k, vector, id_col, own, per_cell)
    return out if keep_self else out.filter(F.col(id_col) != F.col("query_id"))


def ranked(found: DataFrame, keys: list[str], k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` nearest of each of ``keys`` with their ``rank``; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("sim").desc(), id_col))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, keys: list[str] | None = None, vector: str = "embedding", id_col: str = "id", keep_self: bool = True) -> DataFrame:
    """The ``k`` rows nearest to each query, by inner product, within each of ``keys``: query_id, sim and rank.

    Exact. Each batch gives its best only, so what is shuffled is small.
    """
    return ranked(candidates(index, queries, k, keys, vector, id_col, keep_self), ["query_id", *(keys or [])], k, id_col)


def union_results(frames: DataFrame, transcript: DataFrame, queries: DataFrame, keys: list[str] | None = None, settings: Settings = DEFAULT, keep_self: bool = True, threshold: float = 0.0, own: str | None = None) -> DataFrame:
    """Both indexes' results for each query as one list: source, weighted score and ``ord``.

    Each index gives its k nearest, of which those of at least ``threshold`` similarity stay. Frames come
    before transcripts, each in the order of its search. Candidates are united before they are ranked,
    so both searches share a shuffle.
    """
    keys = keys or []
    sides = []
    for place, (index, column, weight, name) in enumerate(((frames, "frame_vector", settings.frame_weight, "frames"), (transcript, "transcript_vector", settings.transcript_weight, "transcript"))):
        asked = queries.select("query_id", F.col(column).alias("vector"), *([own] if own else []))
        found = candidates(index, asked, settings.initial_k, keys, keep_self=keep_self, own=own)
        sides.append(found.withColumn("source", F.lit(name)).withColumn("_side", F.lit(place)).withColumn("_weight", F.lit(weight)))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    by = ["query_id", *keys]
    best = ranked(both, [*by, "_side"], settings.initial_k).filter(F.col("sim") >= threshold)
    order = F.row_number().over(Window.partitionBy(*by).orderBy("_side", "rank")) - 1
    scored = best.withColumn("score", F.round(F.col("sim") * F.col("_weight"), 4)).withColumn("ord", order)
    return scored.drop("_side", "_weight", "rank", "sim")


def dynamic_k(results: DataFrame, keys: list[str], threshold: float = 0.27, min_k: int = 2, max_k: int = 10, ties: list[str] | None = None) -> DataFrame:
    """The results above the threshold, ``max_k`` at most; the best ``min_k`` of all if fewer are above. Adds ``place``."""
    ordered = Window.partitionBy(*keys).orderBy(F.col("score").desc(), *(ties or ["ord"]))
    above = F.count_if(F.col("score") >= threshold).over(Window.partitionBy(*keys))
    placed = results.withColumn("place", F.row_number().over(ordered)).withColumn("_above", above)
    kept = F.when(F.col("_above") < min_k, F.col("place") <= min_k).otherwise((F.col("score") >= threshold) & (F.col("place") <= max_k))
    return placed.filter(kept).drop("_above")


def hybrid(frames: DataFrame, transcript: DataFrame, queries: DataFrame, keys: list[str] | None = None, settings: Settings = DEFAULT, keep_self: bool = True, own: str | None = None) -> DataFrame:
    """Results of a hybrid search for each query (and each of ``keys``), best first by ``place``.

    With ``own``, a column of all three tables, a query is searched in the rows with its value only.

    ``frames`` and ``transcript`` have id, timestamp and embedding; ``queries`` query_id, frame_vector
    and transcript_vector. A null vector leaves its index out.
    """
    by = ["query_id", *(keys or [])]
    return picked(union_results(frames, transcript, queries, keys, settings, keep_self, own=own), by, settings)


def picked(results: DataFrame, by: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """What a hybrid search gives of the united ``results``: the best of each stretch of time, as many as ``dynamic_k`` takes."""
    best = anchored_best(results, by, settings.dedup_sec)
    return dynamic_k(best, by, settings.score_threshold, settings.min_k, settings.max_k, ties=["grp"]).drop("grp")


def in_range(results: DataFrame, start: float, end: float, keys: list[str] | None = None) -> DataFrame:
    """Results between two times, inclusive, of a finished search; places are as they were, ``dynamic_k`` counts what is left."""
    kept = results.filter(F.col("timestamp").between(start, end))
    return kept.withColumn("dynamic_k", F.count("*").over(Window.partitionBy(*(keys or ["query_id"]))))


def response(results: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: results in order, candidates of each index and dynamic k; zeros where nothing was found."""
    counts = candidates.groupBy("query_id").agg(F.count_if(F.col("source") == "frames").alias("frame_candidates"), F.count_if(F.col("source") == "transcript").alias("transcript_candidates"))
    row = F.struct("place", *[c for c in results.columns if c not in ("place", "query_id")])
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"), F.count("*").alias("dynamic_k"))
    out = queries.select("query_id").distinct().join(counts, "query_id", "left").join(lists, "query_id", "left")
    return out.fillna(0, ["frame_candidates", "transcript_candidates", "dynamic_k"])


def top_videos(results: DataFrame, video: str, gate: float = 0.30, top_n: int = 3, order: list[Column] | None = None) -> DataFrame:
    """The best videos of each query: query_id, video, best_score, n_results and place; ties in the order given."""
    best = results.groupBy("query_id", video).agg(F.max("score").alias("best_score"), F.count("*").alias("n_results")).filter(F.col("best_score") >= gate)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("best_score").desc(), *(order or [F.col(video)])))
    return best.withColumn("place", place).filter(F.col("place") <= top_n)
