"""The adaptive filter as a stream equals the batch, across micro-batches and a restart."""

import numpy as np
import pytest
import test_ingest as stub

from cuepoint.operators import folds
from cuepoint.streaming import ingest as stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield
    spark.conf.set(PROVIDER, before)


def batches(spark, folder, whole, cuts):
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        whole.filter(f"timestamp >= {a} AND timestamp < {b}").repartition(2).write.mode("append").parquet(folder)
        yield


def decisions(frame):
    return sorted((r.video_hash, r.timestamp, r.keep, r.score, r.threshold, r.reset) for r in frame.collect())


def run(spark, tmp_path, whole, cuts, **kw):
    source, out, name = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for _ in batches(spark, source, whole, cuts):  # a new query each time, which takes up the state
        live = stream.adaptive_stream(stream.landing(spark, source, whole.schema), **kw)
        live.writeStream.format("parquet").option("path", out).option("checkpointLocation", name).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_stream_of_vectors_equals_the_batch(spark, tmp_path, rocks):
    rng = np.random.default_rng(4)
    rows = []
    for video in ("a", "b", "c"):
        x = rng.normal(size=4)
        for i in range(60):
            x = x + rng.normal(size=4) * 0.4
            rows.append((video, float(i), i // 13 % 3 - 1, (x / np.linalg.norm(x)).tolist(), "other"))
    whole = spark.createDataFrame(rows, "video_hash string, timestamp double, scene_id int, embedding array<float>, more string").cache()
    kw = {"window": 7, "floor": 0.3, "ceiling": 0.97}
    found = decisions(run(spark, tmp_path, whole, [0, 20, 41, 60], **kw))
    assert found == decisions(folds.adaptive_filter(whole, ["video_hash"], ["timestamp"], "embedding", **kw))
    assert 0 < sum(r[2] for r in found) < len(found)


def test_pictures_late_frames_and_new_videos(spark, tmp_path, rocks):
    picture = lambda i: bytes([i // 6 * 40 % 256, i % 7 + 1])
    rows = [(v, float(i), None if v == "n" else i // 10, bytearray(picture(i))) for v, first in (("v", 0), ("w", 15), ("n", 0)) for i in range(first, 30)]
    whole = spark.createDataFrame(rows, "video_hash string, timestamp double, scene_id int, frame binary").cache()
    late = whole.filter("timestamp < 3 AND video_hash = 'v'")
    kw = {"value": "frame", "similarity": stub.picture_similarity}
    run(spark, tmp_path, whole, [0, 14, 22, 30], **kw)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    live = stream.adaptive_stream(stream.landing(spark, str(tmp_path / "in"), whole.schema), **kw)
    live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    batch = folds.adaptive_filter(whole, ["video_hash"], ["timestamp"], "frame", similarity=stub.picture_similarity)
    assert decisions(spark.read.parquet(str(tmp_path / "out"))) == decisions(batch)
