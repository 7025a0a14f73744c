"""The append log: whole versions, last rows, tombstones, batches that come again, compaction, rivals."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuepoint.operators import registry
from cuepoint.sinks.log import Log
from cuepoint.streaming import ingest as stream

SCHEMA = StructType().add("video_hash", "string").add("id", "long").add("value", "double")


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path / "log"), SCHEMA, ["video_hash", "id"], "video_hash")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def seen(frame):
    return sorted(map(tuple, frame.collect()))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_last_rows_and_deletions(spark, log):
    assert seen(log.read()) == []
    log.append(rows(spark, ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)))
    log.append(rows(spark, ("a", 1, 5.0)), gone=rows(spark, ("b", 1, 0.0), ("c", 9, 0.0)))
    assert seen(log.read()) == [("a", 1, 5.0), ("a", 2, 2.0)]
    assert seen(log.read(1)) == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)]
    # a row wins over a deletion of one commit, the highest by sequence over others
    log.append(rows(spark, ("b", 1, 1.0), ("b", 1, 7.0)), gone=rows(spark, ("b", 1, 0.0)), sequence=F.col("value"))
    assert seen(log.read()) == [("a", 1, 5.0), ("a", 2, 2.0), ("b", 1, 7.0)]


def test_compaction_and_vacuum(spark, log):
    for i in range(4):
        log.append(rows(spark, ("a", 1, float(i)), ("b", i, 1.0)), gone=rows(spark, ("b", i - 1, 0.0)))
    before = seen(log.read())
    assert before == [("a", 1, 3.0), ("b", 3, 1.0)]
    log.compact()
    assert seen(log.read()) == before and len(log.manifest()["folders"]) == 1
    assert log.vacuum() == 4 and seen(log.read()) == before
    log.append(rows(spark, ("a", 2, 1.0)))
    assert len(seen(log.read())) == 3 and log.vacuum() == 0


def test_batch_that_comes_again(spark, log):
    for _ in range(3):
        assert log.append(rows(spark, ("a", 1, 1.0)), stream="s", batch=4) == 1
    log.compact()
    assert log.append(rows(spark, ("a", 1, 9.0)), stream="s", batch=4) == 2
    assert log.append(rows(spark, ("a", 1, 2.0)), stream="other", batch=0) == 3
    assert seen(log.read()) == [("a", 1, 2.0)]


def test_rivals_keep_each_others_commits(spark, log, monkeypatch):
    log.append(rows(spark, ("a", 1, 1.0)))
    rival = Log(spark, log.path, SCHEMA, log.keys, "video_hash")
    real, done = Log._write, []

    def slow(self, frame):
        folder = real(self, frame)
        if self is log and not done:  # another commit and a compaction are published while this one writes
            done.append(rival.append(rows(spark, ("b", 1, 2.0))))
            rival.compact()
        return folder

    monkeypatch.setattr(Log, "_write", slow)
    log.append(rows(spark, ("c", 1, 3.0)))
    assert seen(log.read()) == [("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 3.0)]
    assert not [f for f in os.listdir(f"{log.path}/_manifests") if f.startswith(".") and not f.endswith(".crc")]


def test_unpublished_folders_are_not_seen(spark, log, monkeypatch):
    log.append(rows(spark, ("a", 1, 1.0)))
    monkeypatch.setattr(Log, "_published", lambda self, made: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        log.append(rows(spark, ("a", 1, 2.0)))
    assert seen(log.read()) == [("a", 1, 1.0)]


def test_stream_writes_what_its_batch_has(spark, tmp_path, log):
    log.append(spark.range(20_000).select(F.lit("a").alias("video_hash"), "id", F.rand(1).alias("value")))
    table = size(log.path)
    source = str(tmp_path / "in")
    for value in (1.0, 2.0):
        rows(spark, ("a", 5, value)).write.mode("append").parquet(source)
        stream.log_stream(stream.landing(spark, source, SCHEMA), log, str(tmp_path / "cp"), "s").trigger(availableNow=True).start().awaitTermination()
    assert size(log.path) - table < table / 10
    assert log.read().filter("id = 5").first().value == 2.0 and log.read().count() == 20_000


def test_total_order_without_one_task(spark):
    n = 5000
    frame = spark.range(n).select("id", F.when(F.col("id") % 10 > 0, F.date_format(F.timestamp_seconds(F.col("id") * 7919 % n), "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))
    expected = {r.id: i + 1 for i, r in enumerate(sorted(frame.collect(), key=lambda r: (r.day is None, tuple(-ord(c) for c in r.day or ""), r.id)))}
    got = registry.ranked(frame, F.col("day"), [F.col("id")])
    assert {r.id: r.place for r in got.collect()} == expected
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    one = registry.ranked(frame.withColumn("day", F.lit("x")), F.col("day"), [F.col("id")])
    assert {r.id: r.place for r in one.collect()} == {i: i + 1 for i in range(n)}
    assert registry.ranked(frame.limit(0), F.col("day"), [F.col("id")]).collect() == []
