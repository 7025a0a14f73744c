"""Indexing decodes and embeds each frame once, goes on where a run died, and cuts long recordings."""

import os
import uuid
from collections import Counter

import pytest
import test_ingest as stub

from cuepoint import schemas
from cuepoint.plans import ingest
from cuepoint.plans.stages import Stages
from cuepoint.sources import media


def counting(folder, name, factory, count=lambda *a: 1):
    """A factory whose model notes what it's called for."""

    def made():
        model = factory()

        def call(*args):
            with open(os.path.join(folder, f"{name}-{uuid.uuid4().hex}"), "w") as f:
                f.write(str(count(*args)))
            return model(*args)

        return call

    return made


def noted(folder):
    total = Counter()
    for f in os.listdir(folder):
        total[f.split("-")[0]] += int(open(os.path.join(folder, f)).read())
    return total


def models(folder, vectors=stub.pictures):
    frames = lambda path, first, last, step: len(range(first, last + 1, step))
    return ingest.Models(
        counting(folder, "probe", stub.probe), counting(folder, "decode", stub.decode, frames), counting(folder, "scenes", stub.scenes), counting(folder, "speech", stub.speech),
        counting(folder, "pictures", vectors, len), counting(folder, "words", stub.words, len), stub.picture_similarity,
    )


@pytest.fixture
def videos(spark):
    return spark.createDataFrame([("1", "one.mp4", "/one.mp4"), ("2", "two.mp4", "/two.mp4")], "video_hash string, video_name string, path string")


def index(spark, videos, folder, used):
    known = spark.createDataFrame([], schemas.REGISTRY)
    return sorted(tuple(r.asDict()[c] for c in schemas.REGISTRY.names if c != "date_indexed") for r in ingest.index_videos(spark, videos, known, folder, used).collect())


def tables(spark, folder):
    return [sorted(map(tuple, t.collect()), key=str) for t in ingest.search_tables(spark, folder)]


def test_each_frame_is_decoded_and_embedded_once(spark, tmp_path, videos):
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = index(spark, videos, str(tmp_path / "index"), models(str(seen)))
    assert len(rows) == 2
    # 120 frames at 2 a second, one wanted a second; 9 of each recording's pictures pass the pixel filter
    assert noted(seen) == {"probe": 2, "decode": 120, "scenes": 2, "speech": 2, "pictures": 18, "words": 6}
    assert not os.path.exists(tmp_path / "index" / "_stages")


def broken():
    def call(parts):
        raise RuntimeError("no model")

    return call


def test_run_that_died_goes_on(spark, tmp_path, videos):
    whole, seen = str(tmp_path / "whole"), tmp_path / "seen"
    seen.mkdir()
    expected = index(spark, videos, whole, models(str(seen)))
    for f in os.listdir(seen):
        os.remove(seen / f)
    folder = str(tmp_path / "index")
    with pytest.raises(Exception, match="no model"):
        index(spark, videos, folder, models(str(seen), broken))
    assert noted(seen)["decode"] == 120
    assert index(spark, videos, folder, models(str(seen))) == expected
    assert noted(seen)["decode"] == 120 and noted(seen)["probe"] == 2 and noted(seen)["speech"] == 2
    assert tables(spark, folder) == tables(spark, whole)


def test_steps_are_made_for_what_lacks_them(spark, tmp_path, videos):
    stages, made = Stages(spark, str(tmp_path), ingest.DEFAULT), []

    def step(left):
        made.append(sorted(r.video_hash for r in left.collect()))
        return left.select("video_hash", "path")

    first = stages.step("s", videos.limit(0), step)
    assert first.collect() == [] and first.columns == ["video_hash", "path"]
    stages.step("s", videos.filter("video_hash = '2'"), step)
    assert sorted(r.path for r in stages.step("s", videos, step).collect()) == ["/one.mp4", "/two.mp4"]
    assert made == [[], ["2"], ["1"]]
    assert Stages(spark, str(tmp_path), ingest.DEFAULT.__class__(window=7)).folder != stages.folder
    stages.clear()
    assert not os.path.exists(tmp_path / "_stages")


def test_long_recording_is_decoded_in_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RANGE_FRAMES", 10)
    one = spark.createDataFrame([("v", "/v.mp4", 2.0, 121), ("none", "/n.mp4", 2.0, 0)], "video_hash string, path string, fps double, total_frames int")
    got = media.decoded_frames(one, stub.decode)
    assert sorted((r.frame_idx, r.timestamp) for r in got.collect()) == [(i, i / 2) for i in range(0, 121, 2)]
    assert got.rdd.glom().map(len).filter(lambda n: n > 0).count() > 1
    part = media.decoded_frames(one, counting(str(tmp_path), "decode", stub.decode, lambda p, a, b, s: len(range(a, b + 1, s))), start_sec=10.0, end_sec=20.0)
    assert sorted(r.timestamp for r in part.collect()) == [float(t) for t in range(10, 21)] and noted(tmp_path) == {"decode": 11}


def test_filters_in_parts_give_the_same_index(spark, videos, tmp_path):
    from dataclasses import replace

    from cuepoint.config import DEFAULT

    found = []
    for parts in (0, 3):
        folder = str(tmp_path / f"parts{parts}")
        known = spark.createDataFrame([], schemas.REGISTRY)
        used = ingest.Models(stub.probe, stub.decode, stub.scenes, stub.speech, stub.pictures, stub.words, stub.picture_similarity)
        ingest.index_videos(spark, videos, known, folder, used, settings=replace(DEFAULT, fold_parts=parts))
        found.append(tables(spark, folder))
    assert found[0] == found[1] and found[0][0]
