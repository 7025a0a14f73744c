"""Frames as a data source: filters reach the decoder, ranges go to tasks, rows equal those of the plain path."""

import pytest
import test_ingest as stub
from test_stages import counting, noted

from cuepoint.sources import frames, media

SHAPE = "video_hash string, path string, fps double, total_frames int"


@pytest.fixture
def videos(spark):
    rows = [("a", "/a", 2.0, 120), ("b", "/b", 16.0, 4001), ("c", "/c", 29.97, 20_000), ("d", "/d", 0.4, 9), (None, "/n", 1.0, 3)]
    return spark.createDataFrame(rows + [("x", "/x", None, 5), ("y", None, 1.0, 5), ("z", "/z", 0.0, 5), ("w", "/w", 1.0, 0), ("v", "/v", 1.0, None)], SHAPE), spark.createDataFrame(rows, SHAPE)


def rows(frame):
    return sorted((r.video_hash or "", r.frame_idx, r.timestamp, bytes(r.frame)) for r in frame.select("video_hash", "frame_idx", "timestamp", "frame").collect())


@pytest.mark.parametrize("start,end", [(None, None), (3.3, 47.7), (0.5, None), (None, 30.0), (1e6, None), (9.0, 2.0)])
def test_equals_decoded_frames(spark, videos, start, end):
    every, table = videos
    fps = 4.0 if start else 1.0
    assert rows(frames.frame_table(every, stub.decode, fps, start, end)) == rows(media.decoded_frames(table, stub.decode, fps, start, end))


@pytest.mark.parametrize(
    "condition,decoded",
    [
        ("video_hash = 'b' AND timestamp BETWEEN 10 AND 20", 11),
        ("video_hash IN ('a', 'd', 'none') AND frame_idx < 40", 29),
        ("video_hash = 'a' AND video_hash = 'b'", 0),
        ("timestamp = 0.063 AND video_hash = 'b'", 0),
        ("video_hash = 'c' AND frame_idx > 19000 AND timestamp <= 650", 16),
        ("frame_idx > 100 AND frame_idx < 100", 0),
        ("video_hash = 'd'", 9),
    ],
)
def test_filters_reach_the_decoder(spark, videos, tmp_path, condition, decoded):
    every, table = videos
    calls = tmp_path / "calls"
    calls.mkdir()
    decode = counting(str(calls), "decode", stub.decode, lambda p, a, b, s: len(range(a, b + 1, s)))
    found = rows(frames.frame_table(every, decode).filter(condition))
    assert found == rows(media.decoded_frames(table, stub.decode).filter(condition))
    assert noted(str(calls))["decode"] == decoded


def test_one_recording_is_read_by_many_tasks(spark):
    one = spark.createDataFrame([("v", "/v", 1.0, 10_000)], SHAPE)
    read = frames.frame_table(one, stub.decode)
    assert read.rdd.getNumPartitions() == -(-10_000 // frames.RANGE_FRAMES) and read.count() == 10_000
    few = frames.frame_table(one, stub.decode, tasks=4)
    assert few.rdd.getNumPartitions() == 4 and rows(few) == rows(read)


def test_short_recordings_share_tasks_and_empty_tables_are_read(spark):
    many = spark.range(500).selectExpr("cast(id AS string) AS video_hash", "concat('/', id) AS path", "2D AS fps", "10 AS total_frames", "id AS extra")
    read = frames.frame_table(many, stub.decode)
    assert read.count() == 2500 and read.rdd.getNumPartitions() == 5
    assert frames.frame_table(many.limit(0), stub.decode).count() == 0


def test_a_decoder_that_gives_more_is_cut(spark):
    one = spark.createDataFrame([("v", "/v", 2.0, 9)], SHAPE)
    every = lambda: lambda path, first, last, step: ((i, b"x") for i in range(20))
    assert [r[1] for r in rows(frames.frame_table(one, every))] == [0, 2, 4, 6, 8]
