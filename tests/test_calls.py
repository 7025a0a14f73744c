"""Each different prompt is asked once, and all that is made of its reply agrees."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from cuepoint.config import DEFAULT
from cuepoint.operators import calls
from cuepoint.plans import ask


def logging_model(folder, reply):
    """A model that leaves a file for each call."""

    def model(prompt):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(str(prompt))
        return reply(prompt)

    return model


def logged(folder):
    return [open(os.path.join(folder, f)).read() for f in os.listdir(folder)]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(i, f"p{i % 4}") for i in range(20)], "id int, prompt string").repartition(5)


def test_equal_prompts_are_asked_once(spark, tmp_path, asked):
    got = calls.replies(asked, ["id"], logging_model(str(tmp_path), lambda p: f"{p}-{uuid.uuid4()}"), "r")
    first, again = got.collect(), got.collect()
    assert sorted(first) == sorted(again) and sorted(logged(tmp_path)) == ["p0", "p1", "p2", "p3"]
    assert len({r.r for r in first}) == 4 and len(first) == 20


def test_named_ledger_is_kept(spark, tmp_path, asked):
    seen, ledger = tmp_path / "seen", str(tmp_path / "ledger")
    seen.mkdir()

    def some_fail(p):
        if p == "p1":
            raise RuntimeError
        return p.upper()

    once = {r.id: r.r for r in calls.replies(asked, ["id"], logging_model(str(seen), some_fail), "r", ledger=ledger).collect()}
    assert once[0] == "P0" and once[1] is None and len(logged(seen)) == 4
    # what is answered isn't asked again, what failed is
    more = asked.unionByName(spark.createDataFrame([(99, "new")], "id int, prompt string"))
    twice = {r.id: r.r for r in calls.replies(more, ["id"], logging_model(str(seen), str.lower), "r", ledger=ledger).collect()}
    assert twice[0] == "P0" and twice[1] == "p1" and twice[99] == "new" and len(logged(seen)) == 6


def test_retries_and_threads(spark, tmp_path, asked):
    folder = str(tmp_path)

    def flaky(p):
        if sum(x == p for x in logged(folder)) < 3:
            raise TimeoutError
        return p

    options = ask.with_settings(model_threads=3, model_tries=3, model_wait_sec=0.01)
    got = {r.id: r.r for r in calls.replies(asked, ["id"], logging_model(folder, flaky), "r", options).collect()}
    assert got == {i: f"p{i % 4}" for i in range(20)} and len(logged(folder)) == 12


def test_prompts_of_parts_and_nulls(spark):
    rows = spark.createDataFrame([(1, [("text", "a", None), ("image", "x", b"\x01\x02")]), (2, None)], "id int, prompt array<struct<kind:string,value:string,image:binary>>")
    got = {r.id: r.r for r in calls.replies(rows, ["id"], lambda p: "none" if p is None else repr(p), "r").collect()}
    assert got == {1: "[('text', 'a'), ('image', b'\\x01\\x02')]", 2: "none"}
    assert calls.replies(rows.limit(0), ["id"], repr, "r").collect() == []
    assert [r.r for r in calls.replies(rows, ["id"], None, "r").collect()] == [None, None]


def test_library_answers_from_one_reply(spark, tmp_path):
    rank, write = tmp_path / "rank", tmp_path / "write"
    rank.mkdir(), write.mkdir()
    vectors = [(f"{v}_{i}", v, float(40 * i), [1.0, 0.1 * i], f"words {v} {i}") for v in ("a", "b", "c") for i in range(6)]
    chunks = spark.createDataFrame(vectors, "id string, video_hash string, timestamp double, embedding array<double>, text string")
    frames = chunks.drop("text").withColumn("frame_path", F.concat(F.lit("f/"), "id")).limit(0)
    queries = spark.createDataFrame([("q1", "what", [1.0, 0.0], [1.0, 0.5]), ("q2", " ", [1.0, 0.0], [1.0, 0.5])], "query_id string, query string, frame_vector array<double>, transcript_vector array<double>")
    videos = spark.createDataFrame([(v, f"{v}.mp4", "2024-01-01") for v in ("a", "b", "c")], "video_hash string, video_name string, date_indexed string")

    def chosen(prompt):
        order = sorted(range(5), key=lambda i: uuid.uuid4().hex)
        return f'{{"selected": {order[:3]}}}'

    options = ask.with_settings(score_threshold=0.1)
    got = ask.ask_library(frames, chunks, queries, videos, logging_model(str(rank), chosen), logging_model(str(write), lambda p: p), options).collect()
    assert {r.query_id for r in got} == {"q1"} and len(got) == 3
    for folder in (rank, write):
        prompts = logged(folder)
        assert len(prompts) == len(set(prompts)) == 3
    for r in got:
        # a model that never replies alike: sources, texts, times and the context that the answerer saw are of one reply
        assert len(r.sources) == 3 and r.transcript_used == [s["text"] for s in r.sources]
        assert r.timestamps == sorted(s["timestamp"] for s in r.sources)
        assert all(t in r.response_text for t in r.transcript_used) and r.response_text.count("words") == 3


def test_index_is_scored_once(spark):
    vectors = [(f"a_{i}", "a", float(40 * i), [1.0, 0.1 * i], "t") for i in range(6)]
    chunks = spark.createDataFrame(vectors, "id string, video_hash string, timestamp double, embedding array<double>, text string")
    queries = spark.createDataFrame([("q", "what", [1.0, 0.0], [1.0, 0.5])], "query_id string, query string, frame_vector array<double>, transcript_vector array<double>")
    videos = spark.createDataFrame([("a", "a.mp4", "2024")], "video_hash string, video_name string, date_indexed string")
    out = ask.ask_library(chunks, chunks, queries, videos, None, None, DEFAULT)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
