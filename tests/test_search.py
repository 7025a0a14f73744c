"""The nearest rows by brute force, whatever blocks queries and index are dealt to."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuepoint.operators import search


def tables(spark, n=400, asked=60, seed=3):
    rng = np.random.default_rng(seed)
    grid = rng.integers(-2, 3, (n, 6)).astype(float)  # many ties
    rows = [(i, f"v{i % 7}", [float(x) for x in v] if i % 50 else None) for i, v in enumerate(grid)]
    index = spark.createDataFrame(rows, "id bigint, video string, embedding array<float>").repartition(6)
    queries = spark.createDataFrame([(i, f"v{i % 5}", [float(x) for x in rng.integers(-2, 3, 6)] if i % 11 else None) for i in range(asked)], "query_id bigint, video string, vector array<double>")
    return rows, index, queries


def brute(rows, queries, k, keys=False, own=False, keep_self=True):
    out = []
    for q, video, v in queries:
        if v is None:
            continue
        found: dict = {}
        for i, name, x in rows:
            if x is not None and (not own or name == video) and (keep_self or i != q):
                found.setdefault(name if keys else None, []).append((-float(np.dot(x, v)), i))
        out += [(q, i, r + 1, -s) for own_rows in found.values() for r, (s, i) in enumerate(sorted(own_rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 17, 1])
@pytest.mark.parametrize("keys,own,keep_self", [(False, False, True), (False, False, False), (True, False, True), (False, True, True)])
def test_blocks(spark, monkeypatch, block, keys, own, keep_self):
    if block == 1 and (keys or own):
        return
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    rows, index, queries = tables(spark)
    k = 5
    found = search.candidates(index, queries, k, ["video"] if keys else None, keep_self=keep_self, own="video" if own else None)
    best = search.ranked(found, ["query_id", *(["video"] if keys else [])], k).collect()
    assert sorted((r.query_id, r.id, r["rank"], r.sim) for r in best) == brute(rows, queries.collect(), k, keys, own, keep_self)


def test_no_queries_or_rows(spark):
    _, index, queries = tables(spark, 20, 3)
    assert search.nearest(index, queries.limit(0)).collect() == []
    assert search.nearest(index.limit(0), queries).collect() == []
    assert search.nearest(index, queries.withColumn("vector", F.lit(None).cast("array<double>"))).collect() == []


def test_longer_index_vectors_raise(spark):
    _, index, queries = tables(spark, 20, 3)
    with pytest.raises(Exception, match="differ in length"):
        search.nearest(index, queries.withColumn("vector", F.slice("vector", 1, 3))).collect()


def test_many_queries_are_planned_at_once(spark):
    index = spark.range(1000).select("id", F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"))
    queries = spark.range(100_000).select(F.col("id").alias("query_id"), F.array(*[F.rand(i) for i in range(4)]).alias("vector"))
    search.candidates(index, queries).schema
    begun = time.perf_counter()
    plan = search.candidates(index, queries)
    assert time.perf_counter() - begun < 1
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Range") == 2


def test_later_batches_are_pruned(spark):
    """A task passes on what reaches its k-th best so far, not each batch's best."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        index = spark.range(2000).coalesce(1).select("id", F.array(F.lit(-1.0) * F.col("id")).cast("array<float>").alias("embedding"))
        queries = spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<double>")
        assert search.candidates(index, queries, 3).count() == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("keys,own", [(False, False), (True, False), (False, True)])
def test_cells_of_many_queries(spark, monkeypatch, keys, own):
    """More queries than are sent to all tasks meet rows of the index, not packs of them, and little is held of what is found."""
    for name, value in (("QUERY_BLOCK", 5), ("CELL_BLOCKS", 4), ("CELL_ROWS", 70), ("_SIMS", 64), ("_HELD", 40), ("_HELD_BYTES", 2000)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(search, "CELL_BYTES", 12 * 6 * 13)
    rows, index, queries = tables(spark)
    found = search.candidates(index, queries, 3, ["video"] if keys else None, own="video" if own else None)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    best = search.ranked(found, ["query_id", *(["video"] if keys else [])], 3).collect()
    assert sorted((r.query_id, r.id, r["rank"], r.sim) for r in best) == brute(rows, queries.collect(), 3, keys, own)


def test_single_precision_leaves_nothing_out(spark, monkeypatch):
    """Similarities that differ in double precision only are told apart, at any size of numbers; a row of NaN costs no other row."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    for scale in (1.0, 1e-25, 1e12, 1e30):
        rows = [(i, [scale * (1 + i * 1e-12), scale]) for i in range(300)]
        index = spark.createDataFrame([*rows, (1000, [float("nan"), 0.0])], "id bigint, embedding array<double>")
        queries = spark.createDataFrame([(q, [1.0, 0.5]) for q in range(3)], "query_id bigint, vector array<double>")
        best = search.nearest(index, queries, 4).collect()
        assert sorted((r.query_id, r["rank"], r.id) for r in best) == [(q, n + 1, i) for q in range(3) for n, i in enumerate((1000, 299, 298, 297))]


def test_cells_hold_few_values_of_the_keys(spark, monkeypatch):
    """A video's rows meet in as many cells as they fill, not in all: each cell gives k rows a query and video. Large videos are cut; null is one."""
    for name, value in (("QUERY_BLOCK", 5), ("CELL_BLOCKS", 100), ("CELL_ROWS", 100)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 40 == 0 else f"v{i % 37}" if i % 3 else "long", [float(x) for x in rng.normal(size=4)]) for i in range(3000)]
    index = spark.createDataFrame(rows, "id bigint, video string, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)], "query_id bigint, vector array<double>")
    found = search.candidates(index, queries, 2, ["video"]).cache()
    expected = brute(rows, [(r.query_id, None, r.vector) for r in queries.collect()], 2, keys=True)
    best = search.ranked(found, ["query_id", "video"], 2).collect()
    near = lambda rows: sorted((q, i, n, round(s, 9)) for q, i, n, s in rows)
    assert near((r.query_id, r.id, r["rank"], r.sim) for r in best) == near(expected)
    # 38 videos in one cell each, and one of some 1000 rows in ten: not 39 in thirty
    assert found.count() <= 20 * 2 * (38 + 10)


def test_small_slices_are_scored_in_parts():
    """The first rows of a video are found whole by all queries; their terms aren't gathered at once."""
    import tracemalloc

    import pyarrow as pa

    n, width = 65_536, 64
    cell = search._Cell(["video"], 11, "id", ["id", "video"])
    values = np.random.default_rng(1).normal(size=n * width)
    cell.ask(pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values)))
    rows = pa.StructArray.from_arrays([pa.array(np.arange(12)), pa.array(["a"] * 12)], ["id", "video"])
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(13, dtype=np.int32) * width), pa.array(values[: 12 * width]))
    cell._begin()
    tracemalloc.start()
    assert list(cell.meet(rows, vectors)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    found = sum(len(b) for b in cell.end())
    assert found == n * 11


def test_similarities_share_one_room():
    """Steps of a cell leave their similarities in the same room, whatever their shapes, and none sees another's."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for n in (8, 64, 4096):
        flags = rng.random(n) < 0.1
        assert search._marked(flags).tolist() == np.flatnonzero(flags).tolist()
    assert search._marked(np.zeros(16, bool)).tolist() == []

    width, asked, k = 5, 21, 4
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * width), pa.array(m.ravel()))
    queries, x = rng.normal(size=(asked, width)), rng.normal(size=(6000, width))
    cell = search._Cell([], k, "id", ["id"])
    cell.ask(pa.array(np.arange(asked)), lists(queries))
    out, at, rooms = [], 0, []
    for n in (3000, 3, 2000, 1, 996):
        rows = pa.StructArray.from_arrays([pa.array(np.arange(at, at + n))], ["id"])
        out += cell.meet(rows, lists(x[at : at + n]))
        at += n
        rooms.append({id(room) for room in cell.rooms.values()})
    assert rooms[0] and all(r == rooms[0] for r in rooms)
    out += cell.end()
    found = sorted((r["query_id"], -r["sim"], r["id"]) for batch in out for r in batch.to_pylist())
    sims = queries @ x.T
    assert [(q, i) for q, _, i in found] == [(q, int(i)) for q in range(asked) for i in np.argsort(-sims[q])[:k]]
