"""Folds in parts equal those row by row, redo only what a guess got wrong, and use several tasks for one recording."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuepoint.operators import folds, speculative


def walk(spark, recordings, n, seed=0, step=0.3):
    """Unit vectors that drift, with scenes; recordings of very different lengths."""
    rng = np.random.default_rng(seed)
    rows = []
    for v in recordings:
        x = rng.normal(size=4)
        for i in range(n if v == 0 else int(rng.integers(1, 40))):
            x = x + rng.normal(size=4) * step
            rows.append((None if v == 1 else v, float(i), i // 37 % 5 - 1, (x / np.linalg.norm(x)).tolist(), f"row {v} {i}"))
    return spark.createDataFrame(rows, "video int, ts double, scene_id int, embedding array<float>, other string")


def rows(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def both(frame):
    semantic = lambda parts: folds.semantic_filter(frame, ["video"], ["ts"], threshold=0.8, parts=parts)
    adaptive = lambda parts: folds.adaptive_filter(frame, ["video"], ["ts"], "embedding", floor=0.2, ceiling=0.97, parts=parts)
    return semantic, adaptive


@pytest.mark.parametrize("seed,block", [(1, 64), (3, 1)])
def test_parts_equal_the_plain_fold(spark, monkeypatch, seed, block):
    monkeypatch.setattr(speculative.speculative_fold, "__defaults__", (block, 4))
    frame = walk(spark, range(6), 800, seed).cache()
    for made in both(frame):
        expected = rows(made(0))
        assert rows(made(7)) == expected


def test_odd_tables(spark):
    frame = walk(spark, [0], 30)
    for made in both(frame.limit(0)):
        assert made(4).count() == 0
    nans = frame.withColumn("video", F.when(F.col("ts") < 20, F.lit(float("nan"))).otherwise(F.lit(None).cast("double"))).cache()
    for made in both(nans):
        assert rows(made(5)) == rows(made(0))


class Total:
    """A fold that never forgets: the running sum."""

    def __init__(self):
        self.sum = 0

    def save(self):
        return str(self.sum).encode()

    def load(self, saved):
        self.sum = int(saved)

    def step(self, batch):
        out = self.sum + np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))
        self.sum = int(out[-1])
        return [out]


@pytest.mark.parametrize("rounds", [0, 2])
def test_a_fold_that_never_agrees_is_right_too(spark, rounds):
    frame = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("n"))
    out = speculative.speculative_fold(frame, ["k"], ["n"], Total, "total bigint", ["n"], 5, block=8, rounds=rounds)
    assert [(r.n, r.total) for r in out.orderBy("n").collect()] == [(i, i * (i + 1) // 2) for i in range(400)]


def test_one_recording_takes_many_tasks_and_few_rows_are_redone(spark, monkeypatch):
    kept = []
    write = speculative.written
    monkeypatch.setattr(speculative, "written", lambda frame, name: kept.append((name, write(frame, name))) or kept[-1][1])
    n = 20_000
    frame = spark.range(n).select(F.lit(1).alias("video"), F.col("id").alias("ts"), F.array(F.sin(F.col("id") / 9.0).cast("float"), F.cos(F.col("id") / 9.0).cast("float")).alias("embedding"), F.col("id").alias("id"))
    # a cut every 500 rows, where nothing is like what was before
    jump = F.array(*[F.when(F.floor(F.col("id") / 500) % 4 == k, x).otherwise(F.lit(0.0).cast("float")) for k in range(4) for x in (F.col("embedding")[0], F.col("embedding")[1])])
    frame = frame.withColumn("embedding", jump)
    out = folds.semantic_filter(frame, ["video"], ["ts"], threshold=0.9, parts=8)
    assert rows(out) == rows(folds.semantic_filter(frame, ["video"], ["ts"], threshold=0.9))
    assert kept[0][1].select("_part").distinct().count() == 8
    redone = [t.count() for name, t in kept if name == "refolded"]
    assert redone and sum(redone) < n / 2
