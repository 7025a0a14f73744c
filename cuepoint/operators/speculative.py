"""Folds of long recordings in parts: each part starts from a guess, and only what a wrong guess changed is redone.

Rows are dealt by ranges of (keys, order), so one recording may lie in many parts. Every part is folded at once, its
first recording as if it began there. Then a part whose start differs from how the part before it ended is folded again
from there, until the state is what it was at the same place the first time; the rows behind that stay. Parts that
are left differing after a round are taken again. What a fold decides is the same as row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Rows between two places at which states are compared.
BLOCK = 256


def _values(batch: pa.RecordBatch, columns: list[str]) -> list[tuple]:
    """Keys of a batch's rows; null and NaN are keys."""
    return list(zip(*(["nan" if v != v else v for v in batch.column(c).to_pylist()] for c in columns), strict=True))


def _mark(state) -> bytes:
    return hashlib.md5(state.save()).digest()


def _first_pass(keys: list[str], start: Callable, schema: pa.Schema, n_added: int, block: int) -> Callable:
    """Fold a part as if its first recording began in it. ``_mark`` is the state at a block's end, ``_end`` the part's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, key, state, held = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held:
                yield pa.RecordBatch.from_arrays(held, schema=schema)
            values = _values(batch, keys)
            cuts = [i for i in range(1, n) if values[i] != values[i - 1] or not (at + i) % block]
            added, marks = [], [None] * n
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                if state is None or values[a] != key:
                    key, state = values[a], start()
                added.append(state.step(batch.slice(a, b - a)))
                if not (at + b) % block:
                    marks[b - 1] = _mark(state)
            new = [pa.concat_arrays([pa.array(p[i]) if not isinstance(p[i], pa.Array) else p[i] for p in added]) for i in range(n_added)]
            held = [*batch.columns, *new, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(marks, pa.binary()), pa.nulls(n, pa.binary())]
            at += n
        if held:
            held[-1] = pa.array([None] * (len(held[-1]) - 1) + [state.save()], pa.binary())
            yield pa.RecordBatch.from_arrays(held, schema=schema)

    return run


def _again(keys: list[str], start: Callable, schema: pa.Schema, n_added: int, block: int) -> Callable:
    """Fold parts' first recordings from the states that stand before them (``_at`` = -1) until a state is as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, state = None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts, places, values = batch.column("_part").to_pylist(), batch.column("_at").to_pylist(), _values(batch, keys)
            was = batch.column("_mark").to_pylist()
            ends = batch.column("_end")
            cuts = [i for i in range(1, n) if parts[i] != parts[i - 1] or values[i] != values[i - 1] or places[i - 1] < 0 or not places[i] % block]
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                if places[a] < 0:
                    part, key, state = parts[a], None, start()
                    state.load(ends[a].as_py())
                    continue
                key = values[a] if key is None else key
                if state is None or values[a] != key:
                    state = None  # agreed, or the part's next recording
                    continue
                size = b - a
                added = state.step(batch.slice(a, size))
                mark = None if (places[b - 1] + 1) % block else _mark(state)
                end = state.save() if ends[b - 1].is_valid else None
                tail = lambda x: pa.array([None] * (size - 1) + [x], pa.binary())  # noqa: B023, E731
                new = [pa.array(x) if not isinstance(x, pa.Array) else x for x in added]
                yield pa.RecordBatch.from_arrays([*new, pa.array([part] * size, pa.int32()), pa.array(places[a:b], pa.int64()), tail(mark), tail(end)], schema=schema)
                if mark is not None and mark == was[b - 1]:
                    state = None

    return run


def speculative_fold(frame: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], added: str, reads: list[str], parts: int, block: int = BLOCK, rounds: int = 4) -> DataFrame:
    """``sorted_fold`` in ``parts`` parts, whatever the lengths of recordings.

    ``start()`` makes a state with ``step``, as there, and ``save()`` and ``load(bytes)``; ``reads`` are the columns
    that ``step`` looks at, ``order`` has to be total. After ``rounds`` rounds only the first of several differing parts in
    a row is redone, whose start is certain: a fold that forgets nothing costs a job for each part, and in all
    ``rounds`` + 1 times the work of a plain one. The driver holds the keys and digests at the parts' borders.
    An empty table stays empty; columns may have any names that don't begin with an underscore.
    """
    names = [piece.split()[0] for piece in added.split(", ")]
    kept = [c for c in frame.columns if c not in names]
    inner = "_part int, _at bigint, _mark binary, _end binary"
    dealt = frame.select(*kept).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    spark = frame.sparkSession
    first = written(dealt.mapInArrow(_first_pass(keys, start, _arrow(spark, f"{fields}, {added}, {inner}"), len(names), block), f"{fields}, {added}, {inner}"), "folded")

    heads: dict[int, tuple] = {}
    tails: dict[int, tuple] = {}
    ends: dict[int, str] = {}
    for r in first.filter("_at = 0 OR _end IS NOT NULL").select("_part", "_at", F.md5("_end").alias("_digest"), F.struct(*keys).alias("_key")).collect():
        key = tuple("nan" if v != v else v for v in r["_key"])
        if r["_at"] == 0:
            heads[r["_part"]] = key
        if r["_digest"] is not None:
            tails[r["_part"]], ends[r["_part"]] = key, r["_digest"]
    present = sorted(heads)
    before = {b: a for a, b in zip(present[:-1], present[1:], strict=True) if heads[b] == tails[a]}
    assumed = dict.fromkeys(before, hashlib.md5(start().save()).hexdigest())

    fixes: list[DataFrame] = []
    changed = [*names, "_mark", "_end"]
    while stale := [p for p, a in before.items() if assumed[p] != ends[a]]:
        if len(fixes) >= rounds:
            stale = [p for p in stale if before[p] not in stale]
        rows = _corrected(first, fixes, changed)
        needed = list(dict.fromkeys([*keys, *reads]))
        follows = F.create_map(*[F.lit(x) for p in stale for x in (before[p], p)])
        states = rows.filter(F.col("_part").isin([before[p] for p in stale]) & F.col("_end").isNotNull()).select(*[F.lit(None).cast(first.schema[c].dataType).alias(c) for c in needed], follows[F.col("_part")].alias("_part"), F.lit(-1).cast("bigint").alias("_at"), F.lit(None).cast("binary").alias("_mark"), "_end")
        again = rows.filter(F.col("_part").isin(stale)).select(*needed, "_part", "_at", "_mark", "_end").unionByName(states)
        again = again.repartition(min(len(stale), parts), "_part").sortWithinPartitions("_part", "_at")
        shape = f"{added}, {inner}"
        fix = written(again.mapInArrow(_again(keys, start, _arrow(spark, shape), len(names), block), shape), "refolded")
        assumed.update({p: ends[before[p]] for p in stale})
        ends.update({r["_part"]: r["_digest"] for r in fix.filter("_end IS NOT NULL").select("_part", F.md5("_end").alias("_digest")).collect()})
        fixes.append(fix)
    return _corrected(first, fixes, changed).select(*kept, *names)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _corrected(first: DataFrame, fixes: list[DataFrame], columns: list[str]) -> DataFrame:
    """Rows of the first pass with the last correction of each that has one."""
    if not fixes:
        return first
    rows = fixes[0].withColumn("_round", F.lit(0))
    for i, fix in enumerate(fixes[1:], 1):
        rows = rows.unionByName(fix.withColumn("_round", F.lit(i)))
    last = rows.groupBy("_part", "_at").agg(F.max_by(F.struct(*columns), "_round").alias("_fix"))
    both = first.join(last, ["_part", "_at"], "left")
    return both.select(*[F.when(F.col("_fix").isNotNull(), F.col("_fix")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in first.columns])
