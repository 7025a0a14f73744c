"""Indexing with stub models, and incremental ingest."""

import numpy as np
import pandas as pd

from cuepoint import schemas
from cuepoint.operators import folds
from cuepoint.plans import ask, ingest
from cuepoint.streaming import ingest as stream


def probe():
    return lambda path: {"fps": 2.0, "total_frames": 120, "width": 8, "height": 8}


def decode():
    def frames(path, first, last, step):
        for i in range(first, last + 1, step):
            yield i, bytes([i // 20 * 40 % 256, i % 7])

    return frames


def scenes():
    return lambda path: [(0.0, 30.0), (30.0, 60.0)]


def speech():
    return lambda path: [{"id": i, "start": 12.0 * i, "end": 12.0 * i + 10, "text": f" word{i} talk "} for i in range(5)]


def pictures():
    return lambda parts: [np.eye(16)[p[0] // 40] for p in parts]


def words():
    from cuepoint.adapters import HashedWords

    return HashedWords(16)


def pixels(a, b):
    return 0.4 if bytes(a)[:1] != bytes(b)[:1] else 0.99


def picture_similarity(a, b):
    a, b = (x.item() if hasattr(x, "item") else x for x in (a, b))
    return pixels(a, b)


def test_index_and_ask(spark, tmp_path):
    models = ingest.Models(probe, decode, scenes, speech, pictures, words, picture_similarity)
    videos = spark.createDataFrame([("v1", "one.mp4", "/one.mp4"), ("v2", "two.mp4", "/two.mp4")], "video_hash string, video_name string, path string")
    known = spark.createDataFrame([], schemas.REGISTRY)
    rows = ingest.index_videos(spark, videos, known, str(tmp_path), models).collect()
    assert {r.video_hash for r in rows} == {"v1", "v2"}
    assert all(r.total_keyframes == 6 and r.total_chunks == 3 and r.thumbnail_path for r in rows)
    frames, chunks = ingest.search_tables(spark, str(tmp_path))
    assert frames.count() == 12 and chunks.count() == 6
    from cuepoint.adapters import query_vectors

    asked = query_vectors(spark.createDataFrame([("q", "word3 talk")], "query_id string, query string"), "query", words, words)
    answer = ask.ask(frames, chunks, asked, "v1", None, lambda p: "yes").first()
    assert answer.response_text == "yes" and answer.timestamps
    # a model that takes pictures gets them as parts, frames of its own video
    from cuepoint.sources import json_files, media

    seen = lambda parts: ",".join(k if k == "text" else v.hex() for k, v in parts)
    shown = ask.ask(frames, chunks, asked, "v1", None, seen, ask.with_settings(score_threshold=-1.0), pictures=media.pictures(spark, f"{tmp_path}/keyframes")).first()
    if shown.keyframe_paths:
        assert sum(len(p) == 4 for p in shown.response_text.split(",") if p != "text") == len(shown.keyframe_paths)
    sizes = {r["name"]: r["rows"] for r in __import__("cuepoint.sinks.tables", fromlist=["x"]).collections(spark, str(tmp_path)).collect()}
    assert sizes == {"v1_frames": 6, "v2_frames": 6, "v1_transcript": 3, "v2_transcript": 3}
    spoken = json_files.segments(spark, f"{tmp_path}/transcripts", "video_hash").filter("video_hash = 'v1'").orderBy("pos").collect()
    assert [r.text for r in spoken] == [f"word{i} talk" for i in range(5)]
    again = ingest.index_videos(spark, videos, spark.createDataFrame(rows, schemas.REGISTRY), str(tmp_path), models)
    assert again.count() == 2 and ingest.search_tables(spark, str(tmp_path))[0].count() == 12


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(v, float(t), (x / np.linalg.norm(x)).tolist()) for v in ("a", "b") for t, x in enumerate(rng.normal(size=(40, 3)))]
    schema = "video_hash string, timestamp double, embedding array<float>"
    source, out = tmp_path / "in", str(tmp_path / "out")
    whole = spark.createDataFrame(rows, schema)
    for part in range(2):
        whole.filter((whole.timestamp >= 20 * part) & (whole.timestamp < 20 * (part + 1))).coalesce(1).write.mode("append").parquet(str(source))
        live = stream.semantic_stream(stream.landing(spark, str(source), whole.schema), threshold=0.5)
        query = live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()
    batch = folds.semantic_filter(whole, ["video_hash"], ["timestamp"], threshold=0.5).filter("keep")
    got = sorted((r.video_hash, r.timestamp) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.video_hash, r.timestamp) for r in batch.collect())


def test_upsert_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    for value in (1.0, 2.0):
        spark.createDataFrame(pd.DataFrame([("x", "a", 1, value, "p", "", [1.0])], columns=schemas.FRAME_INDEX.names), schemas.FRAME_INDEX).write.mode("append").parquet(source)
        rows = stream.landing(spark, source, schemas.FRAME_INDEX)
        stream.upsert_stream(rows, path, schemas.FRAME_INDEX, ["id"], str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.id, r.timestamp) for r in spark.read.schema(schemas.FRAME_INDEX).parquet(path).collect()] == [("x", 2.0)]
