"""Recordings that land one after the other give the index of one batch run, each decoded once."""

import pytest
import test_ingest as stub
from test_stages import counting, noted, tables

from cuepoint import schemas
from cuepoint.plans import ingest
from cuepoint.sources import json_files, media
from cuepoint.streaming import ingest as stream


def models(folder, speech=stub.speech):
    frames = lambda path, first, last, step: len(range(first, last + 1, step))
    return ingest.Models(stub.probe, counting(folder, "decode", stub.decode, frames), stub.scenes, speech, stub.pictures, stub.words, stub.picture_similarity)


def made(tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    return folder


def registered(spark, folder):
    return sorted(tuple(r.asDict()[c] for c in schemas.REGISTRY.names if c not in ("date_indexed", "video_path")) for r in json_files.registry(spark, f"{folder}/registry.json").collect())


def run(spark, landing, folder, used, state):
    stream.index_stream(spark, landing, folder, used, state).trigger(availableNow=True).start().awaitTermination()


def broken():
    def fail(path):
        raise RuntimeError("no speech today")

    return fail


def test_two_batches_and_a_failure_equal_one_run(spark, tmp_path):
    files, landing, calls, whole = (str(made(tmp_path, n)) for n in ("files", "landing", "calls", "whole"))
    for name, size in (("one.mp4", 10), ("two.mp4", 20), ("three.txt", 5)):
        (tmp_path / "files" / name).write_bytes(b"x" * size)
    live, state = str(tmp_path / "live"), str(tmp_path / "state")
    used = models(calls)
    for name in ("one.mp4", "two.mp4"):
        media.land(spark, f"{files}/{name}", landing)
        with pytest.raises(Exception, match="no speech today"):  # the run dies behind the decoding
            run(spark, landing, live, models(calls, broken), state)
        run(spark, landing, live, used, state)
    # one recording lands again under another folder: nothing is done
    media.land(spark, f"{files}/one.mp4", f"{landing}/again")
    run(spark, landing, live, used, state)
    assert noted(calls)["decode"] == 2 * 60
    ingest.index_path(spark, files, whole, models(str(made(tmp_path, "other"))))
    assert tables(spark, live) == tables(spark, whole) and tables(spark, live)[0]
    assert registered(spark, live) == registered(spark, whole)


def test_landing_leaves_no_parts_and_keeps_what_is_there(spark, tmp_path):
    files, landing = made(tmp_path, "files"), made(tmp_path, "landing")
    (files / "a.mp4").write_bytes(b"new")
    media.land(spark, str(files / "a.mp4"), str(landing))
    (files / "a.mp4").write_bytes(b"newer")
    media.land(spark, str(files / "a.mp4"), str(landing))
    assert [p.name for p in landing.iterdir() if not p.name.endswith(".crc")] == ["a.mp4"] and (landing / "a.mp4").read_bytes() == b"new"
