"""Operators on literal rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuepoint.adapters import HashedWords, query_vectors, with_embeddings
from cuepoint.config import DEFAULT
from cuepoint.functions import replies, text
from cuepoint.functions.vectors import dot, normalised
from cuepoint.operators import context, folds, metrics, registry, search, timeline
from cuepoint.plans import ask
from cuepoint.sinks import tables
from cuepoint.sources import json_files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_clocks(spark):
    assert value(spark, text.minutes_clock(F.lit(4503.9))) == "75:03"
    assert value(spark, text.hours_clock(F.lit(4503.0))) == "1:15:03"
    assert value(spark, text.hours_clock(F.lit(59.0))) == "00:59"
    assert value(spark, text.clock_seconds(F.lit("1:15:03"))) == 4503


@pytest.mark.parametrize(("written", "expected"), [("1:13, 37:26", [73.0, 2246.0]), ("1:13:05", [4385.0]), ("73, x", [73.0]), ("", []), ("1:xx, 5.25, , 1:2:3:4, a:1", [5.3]), ("1:02.5", [62.5])])
def test_parse_times(spark, written, expected):
    assert value(spark, text.parse_times(F.lit(written))) == expected


def test_names(spark):
    assert value(spark, text.display_name(F.lit(""), F.lit("a.mp4"))) == "a.mp4"
    assert value(spark, text.display_name(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "Untitled"
    assert value(spark, text.display_name(F.lit(""), F.lit(""))) == ""
    assert value(spark, text.frame_file(F.lit(7), F.lit(1.5))) == "frame_000007_t1.50.jpg"
    assert value(spark, text.shown_pct(F.lit(-1.0))) == "N/A"
    assert value(spark, text.static_url(F.lit("/a/b.mp4"))) == "app/static/videos/b.mp4"
    assert value(spark, text.clipped(F.lit("abcdef"), 3)) == "abc..."
    assert value(spark, text.strip(F.lit("\t a b \n"))) == "a b"


@pytest.mark.parametrize(
    ("reply", "n", "expected"),
    [
        ('{"selected":[0,9,1.7,true,"x"]}', 3, [0, 1, 1]), ("no", 5, [0, 1, 2]), ("no", 2, [0, 1]), ('```json\n{"selected": [2]}\n```', 3, [2]), ('{"selected": []}', 4, []),
        ('{"a": 1}', 4, []), ("[1, 2]", 4, None), ('{"selected": [-0.5, 3]}', 3, [0]), ('{"selected": 4}', 4, [0, 1, 2]), ("7", 4, [0, 1, 2]), ("no", 0, []),
    ],
)
def test_selected(spark, reply, n, expected):
    assert value(spark, replies.selected(F.lit(reply), F.lit(n))) == expected


def test_vectors(spark):
    assert value(spark, dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    assert value(spark, normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert value(spark, normalised(F.array(F.lit(0.0)))) == [None]


def scenes(spark):
    return spark.createDataFrame([("v", 0, 0.0, 5.0), ("v", 1, 8.0, 10.0)], "video_hash string, scene_id int, start_sec double, end_sec double")


def test_scene_lookup(spark):
    frames = spark.createDataFrame([("v", float(t)) for t in (5, 7, 8, 10, 11, 0)] + [("w", 1.0)], "video_hash string, timestamp double")
    found = {(r.video_hash, r.timestamp): r.scene_id for r in timeline.with_scenes(frames, scenes(spark)).collect()}
    assert found == {("v", 5.0): -1, ("v", 7.0): -1, ("v", 8.0): 1, ("v", 10.0): 1, ("v", 11.0): -1, ("v", 0.0): 0, ("w", 1.0): -1}


def test_tidy_scenes(spark):
    cuts = spark.createDataFrame([("v", 0.0, 1.0), ("v", 1.0, 3.0), ("v", 3.0, 9.0), ("w", 0.0, 1.5)], "video_hash string, start_sec double, end_sec double")
    videos = spark.createDataFrame([("v", 9.0), ("w", 30.0)], "video_hash string, duration_sec double")
    got = sorted(tuple(r) for r in timeline.tidy_scenes(cuts, videos).collect())
    assert got == [("v", 0, 1.0, 3.0), ("v", 1, 3.0, 9.0), ("w", 0, 0.0, 30.0)]


def test_sampling_step(spark):
    assert [value(spark, timeline.sample_step(F.lit(f), 1.0)) for f in (2.5, 29.97, 0.2, 3.5)] == [2, 30, 1, 4]


def chunks(spark, rows, **kw):
    frame = spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], "video_hash string, pos int, start double, end double, text string")
    return sorted((r.chunk_id, r.start_time, r.end_time, r.text) for r in timeline.chunk_transcript(frame, **kw).collect())


def test_chunks(spark):
    assert chunks(spark, [(0.0, 10.0, "a"), (28.0, 33.0, " b "), (90.0, 95.0, "c")]) == [(0, 0.0, 30.0, "a b"), (1, 28.0, 33.0, "b"), (2, 90.0, 95.0, "c")]
    assert chunks(spark, []) == []
    with pytest.raises(ValueError):
        chunks(spark, [], chunk_sec=5.0, overlap_sec=5.0)


def test_chunks_against_loop(spark):
    rng = random.Random(5)
    for length, overlap in ((30.0, 5.0), (10.0, 3.0)):
        at, rows = 0.0, []
        for i in range(60):
            at += rng.choice([0, 0.5, 3, 12, 40])
            rows.append((at, at + rng.choice([0, 0.5, 7, 33, 61]), f"w{i}"))
        expected, start = [], 0.0
        while start < max(r[1] for r in rows):
            own = [r for r in rows if r[0] < start + length and r[1] > start]
            if own:
                expected.append((len(expected), round(own[0][0], 3), round(min(own[-1][1], start + length), 3), " ".join(r[2] for r in own)))
            start += length - overlap
        assert chunks(spark, rows, chunk_sec=length, overlap_sec=overlap) == expected


def anchored(spark, rows):
    frame = spark.createDataFrame([("v", float(t), s, i) for i, (t, s) in enumerate(rows)], "k string, timestamp double, score double, ord int")
    streaming = folds.best_of_groups(folds.anchored_groups(frame, ["k"], "timestamp", ["ord"]), ["k"], F.col("score"), "timestamp", ["ord"])
    arrays = folds.anchored_best(frame, ["k"], 30.0)
    one, two = (sorted((r.grp, r.timestamp) for r in x.collect()) for x in (streaming, arrays))
    assert one == two
    return [t for _, t in one]


def test_anchored_dedup(spark):
    assert anchored(spark, [(0, 1.0), (30, 0.5), (31, 1.0), (61, 0.5), (62, 0.1)]) == [0.0, 31.0, 62.0]
    assert anchored(spark, [(0, 0.1), (30, 0.9), (31, 0.8)]) == [30.0, 31.0]
    assert anchored(spark, [(5, 0.5), (0, 0.5), (5, 0.5)]) == [0.0]


def kept(spark, scores, threshold=0.27):
    frame = spark.createDataFrame([("q", s, i) for i, s in enumerate(scores)], "query_id string, score double, ord int")
    return [r.score for r in search.dynamic_k(frame, ["query_id"], threshold).orderBy("place").collect()]


def test_dynamic_k(spark):
    assert kept(spark, [0.1, 0.5, 0.05]) == [0.5, 0.1]
    assert len(kept(spark, [0.9 - i / 100 for i in range(12)])) == 10
    assert kept(spark, [0.1]) == [0.1]
    assert kept(spark, [0.27, 0.3, 0.26]) == [0.3, 0.27]


def adaptive(spark, rows, **kw):
    """Frames whose similarity to the last kept one is given by a table of scores by position."""
    frame = spark.createDataFrame([("v", i, [float(s)], c) for i, (s, c) in enumerate(rows)], "video_hash string, i int, value array<double>, scene_id int")
    out = folds.adaptive_filter(frame, ["video_hash"], ["i"], "value", similarity=lambda last, own: float(own[0]), **kw)
    return [r.keep for r in out.orderBy("i").collect()]


def test_adaptive_filter(spark):
    assert adaptive(spark, [(0, 0), (0.90, 0)]) == [True, False]
    assert adaptive(spark, [(0, 0), (0.49, 0)]) == [True, True]
    assert adaptive(spark, [(0, 0), (0.50, 0)]) == [True, False]
    assert adaptive(spark, [(0, 0), (0.981, 0)]) == [True, False]
    assert adaptive(spark, [(0, 0), (0.9, 0), (0.70, 1)]) == [True, False, False]
    assert adaptive(spark, [(0, 0), (0.9, 0), (0.70, 0)], multiplier=0.5) == [True, False, True]


def test_semantic_filter(spark):
    rows = [[1.0, 0.0], [0.95, 0.3], [0.0, 1.0], [0.0, 1.0]]
    frame = spark.createDataFrame([("v", i, r) for i, r in enumerate(rows)], "video_hash string, i int, embedding array<float>")
    out = folds.semantic_filter(frame, ["video_hash"], ["i"], threshold=float(np.float32(0.95)))
    assert [r.keep for r in out.orderBy("i").collect()] == [True, False, True, False]
    stats = folds.filter_stats(out, ["video_hash"]).first()
    assert (stats.total_input, stats.total_kept, stats.total_dropped, stats.reduction_pct) == (4, 2, 2, 50.0)
    empty = folds.filter_stats(out.filter("false"), []).first()
    assert (empty.total_input, empty.reduction_pct, empty.mean_score, empty.std_score) == (0, 0.0, 0.0, 0.0)
    again = folds.semantic_filter(out.filter("keep").select("video_hash", "i", "embedding"), ["video_hash"], ["i"])
    assert all(r.keep for r in again.collect())


def test_ssim():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    assert folds.ssim(a, a) == pytest.approx(1.0)
    assert folds.ssim(a, 255 - a) < 0.1
    assert folds.ssim(a, np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8)) > 0.95


@pytest.mark.parametrize("held", [1, 700, 1 << 20])
def test_stacks_of_pictures(spark, monkeypatch, held):
    """Stacks of one picture, of a few and of all give what single pictures do, with nulls between them."""
    monkeypatch.setattr(folds, "STACK_BYTES", held)
    rng = np.random.default_rng(2)
    color = [None if i % 5 == 2 else rng.integers(0, 256, (6, 9, 3)).astype(np.uint8) for i in range(40)]
    raw = lambda x: None if x is None else x.tobytes()
    rows = [(i, raw(x), raw(color[i - 3])) for i, x in enumerate(color)]
    frames = spark.createDataFrame(rows, "i int, now binary, before binary").repartition(3)
    gray = {r.i: r for r in folds.gray_frames(folds.gray_frames(frames, "now", 6, 9, "a"), "before", 6, 9, "b").select("i", "a", "b").collect()}
    for i, x in enumerate(color):
        assert gray[i].a == (None if x is None else folds.gray(x).astype(np.uint8).tobytes())
    pairs = spark.createDataFrame(list(gray.values()), "i int, a binary, b binary")
    for r in folds.frame_similarity(pairs, "a", "b", 6, 9).collect():
        x, y = color[r.i], color[r.i - 3]
        assert r.ssim == (None if x is None or y is None else pytest.approx(folds.ssim(folds.gray(x), folds.gray(y)), abs=1e-9))
    none = frames.select("i", F.lit(None).cast("binary").alias("a"), F.col("now").alias("b")).limit(5)
    assert {r.ssim for r in folds.frame_similarity(none, "a", "b", 6, 27).collect()} == {None}
    with pytest.raises(Exception, match="(?i)invalid|size|length|bytes"):
        folds.gray_frames(frames, "now", 6, 8).collect()


def budget(spark, lines, size):
    frame = spark.createDataFrame([("c", float(i), i, x) for i, x in enumerate(lines)], "k string, timestamp double, ord int, text string")
    got = context.budgeted_context(frame, ["k"], size).collect()
    return got[0].context if got else ""


def test_context_budget(spark):
    a, b = "a" * 32, "b" * 32
    assert budget(spark, [a, b], 60) == "[00:00] " + a
    assert budget(spark, [a, "b" * 72], 100) == "[00:00] " + a + "\n\n" + ("[00:01] " + "b" * 72)[:60] + "..."
    assert budget(spark, [a, b], 80) == "[00:00] " + a + "\n\n[00:01] " + b
    assert budget(spark, [None, ""], 80) == ""


def results(spark, n=4):
    return spark.createDataFrame([("q", i, float(10 * i), 0.1 * (i + 1), "transcript" if i % 2 else "frames", f"t{i}" if i % 2 else "", "" if i % 2 else f"f{i}.jpg", "what") for i in range(n)], "query_id string, place int, timestamp double, score double, source string, text string, frame_path string, query string")


def places(spark, n, model):
    return [r.timestamp for r in context.rerank(results(spark, n), ["query_id"], [F.col("place")], model).orderBy("place").collect()]


def test_rerank(spark):
    def fails(_):
        raise RuntimeError

    assert places(spark, 2, fails) == [0.0, 10.0]
    assert places(spark, 4, lambda p: '{"selected": [3, 0]}') == [30.0, 0.0]
    assert places(spark, 7, lambda p: '{"selected": []}') == [0.0, 10.0, 20.0, 30.0, 40.0]
    assert places(spark, 7, fails) == [60.0, 50.0, 40.0, 30.0, 20.0]
    assert places(spark, 7, None) == [60.0, 50.0, 40.0, 30.0, 20.0]
    assert places(spark, 4, lambda p: "?") == [0.0, 10.0, 20.0]
    assert places(spark, 4, lambda p: '{"selected": [1, 1]}') == [10.0, 10.0]


def test_answers(spark):
    queries = spark.createDataFrame([("q", "what"), ("none", "x")], "query_id string, query string")
    got = {r.query_id: r for r in context.answers(results(spark), queries, ["query_id"], lambda p: "written: " + p[-4:], "m").collect()}
    assert got["q"].response_text == "written: what" and got["q"].keyframe_paths == ["f0.jpg", "f2.jpg"] and got["q"].timestamps == [0.0, 10.0, 20.0, 30.0]
    assert got["none"].response_text == context.NOTHING_FOUND and got["none"].sources == []
    failed = {r.query_id: r for r in context.answers(results(spark), queries, ["query_id"], None).collect()}
    assert "00:00, 00:10" in failed["q"].response_text and "[00:10] t1" in failed["q"].response_text


def test_golden_report(spark):
    rows = spark.createDataFrame(
        [("1", "a", [73.04, 2246.2], [73.0, 2246.0]), ("2", "b", [2246.2, 2273.96, 2170.94], [297.0, 369.0])],
        "query_id string, query string, retrieved array<double>, relevant_timestamps array<double>",
    )
    measured = metrics.rounded(metrics.query_metrics(rows, 5, 30.0, "retrieved", "relevant_timestamps"))
    one, two = measured.orderBy("query_id").collect()
    assert (one.precision_at_k, one.recall_at_k, one.reciprocal_rank, one.hit_at_k) == (0.4, 1.0, 1.0, True)
    assert (two.precision_at_k, two.recall_at_k, two.reciprocal_rank, two.hit_at_k) == (0.0, 0.0, 0.0, False)
    total = ask.report(measured, 5).first()
    assert (total.mean_precision_at_k, total.mean_recall_at_k, total.mrr, total.hit_rate_at_k, total.band, total.k) == (0.2, 0.5, 0.5, 0.5, "weak", 5)
    assert len(total.query_results) == 2
    assert ask.report(measured.filter("false"), 5).count() == 0
    assert ask.summary_lines(measured, metrics.macro(measured)).count() == 3


def test_recall_counts_duplicates(spark):
    rows = spark.createDataFrame([([10.0], [10.0, 10.0])], "retrieved array<double>, relevant array<double>")
    assert metrics.query_metrics(rows, 5, 30.0).first().recall_at_k == 0.5
    assert metrics.query_metrics(rows, 0, 30.0).first().precision_at_k == 0.0


def test_range_search_can_be_empty(spark):
    assert search.in_range(results(spark), 1000.0, 2000.0).count() == 0


def index(spark):
    words = ["cats purr softly", "dogs bark loudly", "birds sing songs", "cats and dogs", "fish swim deep", "cats sleep"]
    rows = spark.createDataFrame([(f"{v}_{i}", v, 40.0 * i, w) for v in ("a", "b") for i, w in enumerate(words) if v == "a" or i % 2], "id string, video_hash string, timestamp double, text string")
    return with_embeddings(rows, "text", HashedWords)


def test_ask_across_videos(spark):
    both = index(spark)
    frames = both.drop("text").withColumn("frame_path", F.concat(F.col("id"), F.lit(".jpg")))
    asked = query_vectors(spark.createDataFrame([("q1", "cats purr"), ("q2", "zebra quilt")], "query_id string, query string"), "query", HashedWords, HashedWords)
    videos = spark.createDataFrame([("a", "A", "2024-01-01"), ("b", "B", "2024-01-02")], "video_hash string, video_name string, date_indexed string")
    found = ask.search_video(frames, both, asked, "a").filter("query_id = 'q1'").orderBy("place").collect()
    assert found[0].id == "a_0" and found[0].source == "transcript"
    assert {r.place for r in found} == set(range(1, len(found) + 1))
    got = ask.ask_library(frames, both, asked, videos, None, lambda p: "ok").collect()
    assert {(r.query_id, r.video_hash) for r in got} >= {("q1", "a")} and all(r.response_text == "ok" for r in got)
    one = ask.ask(frames, both, asked, "a", None, None).filter("query_id = 'q1'").first()
    assert one.timestamps
    nothing = ask.ask(frames, both, asked, "missing", None, None).collect()
    assert {r.response_text for r in nothing} == {context.NOTHING_FOUND}


def test_nearest_is_invariant_to_partitions(spark):
    rows = index(spark)
    asked = query_vectors(spark.createDataFrame([("q", "cats sleep")], "query_id string, query string"), "query", HashedWords, HashedWords).select("query_id", F.col("frame_vector").alias("vector"))
    one, many = ([(r.id, r["rank"]) for r in search.nearest(rows.repartition(n), asked, 4).orderBy("rank").collect()] for n in (1, 7))
    assert one == many and one[0][0] in ("a_5", "b_5")
    assert search.nearest(rows, asked.filter("false"), 4).count() == 0
    assert search.nearest(rows.filter("false"), asked, 4).count() == 0


def test_registry(spark):
    rows = spark.createDataFrame([("a", "x.mp4", "", "2024"), ("b", "y.mp4", "Bee", "2025")], "video_hash string, video_name string, custom_name string, date_indexed string")
    renamed = registry.rename(rows, "video_hash", "a", " Ant \n")
    assert {r.video_hash: r.custom_name for r in renamed.collect()} == {"a": "Ant", "b": "Bee"}
    fresh = spark.createDataFrame([("a", "x2.mp4", "", "2026"), ("c", "z.mp4", "", "2026")], rows.schema)
    got = {r.video_hash: (r.video_name, r.custom_name) for r in registry.register(renamed, fresh).collect()}
    assert got == {"a": ("x2.mp4", "Ant"), "b": ("y.mp4", "Bee"), "c": ("z.mp4", "")}
    assert {r.video_hash for r in registry.pending(fresh, rows).collect()} == {"c"}
    assert registry.pending(fresh, rows, force=True).count() == 2
    assert registry.delete(rows, fresh, "video_hash").count() == 1
    once = registry.upsert(rows, fresh, ["video_hash"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, registry.upsert(once, fresh, ["video_hash"]).collect()))
    assert [r.video_hash for r in json_files.listing(rows).collect()] == ["b", "a"]
    names = registry.match_names(rows, ["x", "y.mp4", "nothing"], "video_name", "video_hash")
    assert {(r.wanted, r.video_hash) for r in names.collect()} == {("x", "a"), ("y.mp4", "b")}


def test_files(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"id": 0, "start": 0.0, "end": 1.5, "text": " é "}, {"id": 1, "start": 1.5, "end": 2.0, "text": "b"}]))
    segments = json_files.segments(spark, str(path))
    assert [(r.pos, r.text) for r in segments.orderBy("pos").collect()] == [(0, " é "), (1, "b")]
    tables.segments_json(segments, str(tmp_path / "out"))
    again = json_files.segments(spark, str(tmp_path / "out")).orderBy("pos").collect()
    assert [(r.pos, r.id, r.start, r.text) for r in again] == [(0, 0, 0.0, "é"), (1, 1, 1.5, "b")]
    both = segments.withColumn("video_hash", F.lit("00000012")).unionByName(segments.withColumn("video_hash", F.lit("1e234567")))
    tables.segments_json(both, str(tmp_path / "many"), "video_hash")
    found = json_files.segments(spark, str(tmp_path / "many"), "video_hash").collect()
    assert sorted((r.video_hash, r.pos) for r in found) == [("00000012", 0), ("00000012", 1), ("1e234567", 0), ("1e234567", 1)]
    notes = tmp_path / "a.json"
    notes.write_text(json.dumps({"video_hash": "v", "video_name": "n", "annotations": [{"query": "q", "relevant_timestamps": [1.0, 3700.0], "notes": ""}]}))
    annotated = json_files.annotations(spark, str(notes))
    assert annotated.first().tolerance == 30.0
    assert ask.shown_annotations(annotated).first().times == "00:01, 1:01:40"
    merged = tables.merged_annotations(annotated, annotated.withColumn("query", F.lit("r"))).first()
    assert merged.total_annotations == 2 and [a.query for a in merged.annotations] == ["q", "r"]
    assert json_files.registry(spark, str(tmp_path / "none.json")).count() == 0
    rows = spark.createDataFrame([("a",)], "video_hash string").select("video_hash", *[F.lit(None).cast(f.dataType).alias(f.name) for f in json_files.schemas.REGISTRY.fields[1:]])
    tables.registry_json(rows, str(tmp_path / "registry.json"))
    where = str(tmp_path / "registry.json")
    assert [r.video_hash for r in json_files.registry(spark, where).collect()] == ["a"]
    # rows may come from the file that they replace, and a swap that broke off is read from the old file
    tables.registry_json(json_files.registry(spark, where).withColumn("custom_name", F.lit("x")), where)
    assert [r.custom_name for r in json_files.registry(spark, where).collect()] == ["x"]
    (tmp_path / "registry.json").rename(tmp_path / "registry.json__old")
    assert [r.custom_name for r in json_files.registry(spark, where).collect()] == ["x"]
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception):
        json_files.registry(spark, str(tmp_path / "bad.json")).count()


def test_index_tables(spark, tmp_path):
    from cuepoint import schemas

    path = str(tmp_path / "frames")
    row = lambda i, v: (i, v, 1, 1.0, "p", "", [1.0])
    tables.upsert_rows(spark, spark.createDataFrame([row("a1", "a"), row("b1", "b")], schemas.FRAME_INDEX), path, schemas.FRAME_INDEX, ["id"])
    tables.upsert_rows(spark, spark.createDataFrame([row("a1", "a"), row("a2", "a")], schemas.FRAME_INDEX), path, schemas.FRAME_INDEX, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a1", "a2", "b1"]
    tables.replace_videos(spark.createDataFrame([row("a3", "a")], schemas.FRAME_INDEX), path)
    assert sorted(r.id for r in spark.read.schema(schemas.FRAME_INDEX).parquet(path).collect()) == ["a3", "b1"]
    asked = spark.createDataFrame([("a",), ("b",)], "video_hash string")
    tables.replace_videos(spark.createDataFrame([row("a3", "a")], schemas.FRAME_INDEX), path, videos=asked)
    assert [r.id for r in spark.read.schema(schemas.FRAME_INDEX).parquet(path).collect()] == ["a3"]
    tables.upsert_rows(spark, spark.createDataFrame([row("b1", "b")], schemas.FRAME_INDEX), path, schemas.FRAME_INDEX, ["id"])
    assert not [p for p in tmp_path.iterdir() if "__merge" in p.name]
    left = tables.delete_videos(spark, ["a"], [path], spark.createDataFrame([("a",), ("b",)], "video_hash string"))
    assert left.count() == 1 and [r.id for r in spark.read.schema(schemas.FRAME_INDEX).parquet(path).collect()] == ["b1"]


def test_settings(spark, monkeypatch):
    from cuepoint.config import settings

    assert ask.with_settings(max_k=3).max_k == 3 and DEFAULT.max_k == 10
    monkeypatch.setenv("CUEPOINT_MAX_K", "7")
    monkeypatch.setenv("CUEPOINT_VIDEO_GATE", "0.5")
    assert settings().max_k == 7 and settings(spark).video_gate == 0.5
    spark.conf.set("spark.cuepoint.max_k", "4")
    assert settings(spark).max_k == 4
    spark.conf.unset("spark.cuepoint.max_k")


def test_nan_keys_are_one_fold(spark):
    rows = spark.createDataFrame([(float("nan"), 0.0), (float("nan"), 10.0), (None, 0.0), (None, 5.0), (1.0, 3.0)], "k double, ts double")
    found = folds.anchored_groups(rows, ["k"], "ts", [], 30.0).collect()
    assert all(r.grp == 0 for r in found) and {r.anchor for r in found if r.k != r.k} == {0.0}


def test_factories_are_told_apart():
    import pickle

    from cuepoint.adapters import keyed, once

    factories = [lambda n=n: [n] for n in range(3)]
    assert [once(keyed(f)) for f in factories] == [[0], [1], [2]] and once(keyed(factories[1])) is once(keyed(factories[1]))
    assert pickle.loads(pickle.dumps(keyed(dict))).token == keyed(dict).token


def test_pictures_by_path(spark, tmp_path):
    from cuepoint.sources import media

    frames = spark.createDataFrame([("a", 1, 1.0, b"one"), ("b", 1, 1.0, b"two")], "video_hash string, frame_idx int, timestamp double, frame binary")
    coded = tables.encoded(frames, "frame", lambda raw, quality: raw + str(quality).encode()).drop("frame")
    named = tables.keyframes(coded, str(tmp_path / "keyframes"))
    found = media.images(named, media.pictures(spark, str(tmp_path / "keyframes"))).collect()
    assert sorted((r.video_hash, bytes(r.image)) for r in found) == [("a", b"one95"), ("b", b"two95")]
    wanted = spark.createDataFrame([("x/f.jpg",), ("y/f.jpg",), ("z/f.jpg",)], "frame_path string")
    for folder in "xy":
        (tmp_path / "files" / folder).mkdir(parents=True)
        (tmp_path / "files" / folder / "f.jpg").write_bytes(folder.encode())
    files = media.picture_files(spark, str(tmp_path / "files"))
    shown = media.images(wanted, files, resize=lambda x: x * 2).collect()
    assert {r.frame_path: r.image and bytes(r.image) for r in shown} == {"x/f.jpg": b"xx", "y/f.jpg": b"yy", "z/f.jpg": None}
    place = media.land(spark, str(tmp_path / "files/x/f.jpg"), str(tmp_path / "data"))
    (tmp_path / "data" / "f.jpg").write_bytes(b"kept")
    assert media.land(spark, str(tmp_path / "files/y/f.jpg"), str(tmp_path / "data")) == place and (tmp_path / "data" / "f.jpg").read_bytes() == b"kept"
    tables.saved_frames(frames.select(F.col("video_hash").alias("frame_path"), "frame"), str(tmp_path / "saved"))
    assert media.pictures(spark, str(tmp_path / "saved")).count() == 2


def test_own_video_search(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{v}{i}", v, float(i), rng.normal(size=4).tolist()) for v in "abc" for i in range(20)]
    index = spark.createDataFrame(rows, "id string, video_hash string, timestamp double, embedding array<double>")
    queries = spark.createDataFrame([(f"q{v}{n}", v, rng.normal(size=4).tolist()) for v in "ac" for n in range(2)], "query_id string, video_hash string, vector array<double>")
    own = search.ranked(search.candidates(index, queries, 3, own="video_hash"), ["query_id"], 3)
    every = search.nearest(index, queries, 3, ["video_hash"]).join(queries.select("query_id", "video_hash"), ["query_id", "video_hash"])
    key = lambda rows: sorted((r.query_id, r.rank, r.id) for r in rows.collect())
    assert key(own) == key(every) and len(key(own)) == 12


def test_commands(spark, tmp_path, monkeypatch, capsys):
    from cuepoint.__main__ import main

    where = f"{tmp_path}/registry.json"
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in json_files.schemas.REGISTRY.fields}
    base = spark.createDataFrame([("a", "one.mp4", "/one.mp4"), ("b", "two.mp4", "/two.mp4")], "video_hash string, video_name string, video_path string")
    tables.registry_json(base.select(*[c if c in base.columns else empty[c] for c in empty]), where)
    main(["--folder", str(tmp_path), "rename", "a", " First "])
    main(["--folder", str(tmp_path), "delete", "b"])
    assert [(r.video_hash, r.custom_name) for r in json_files.registry(spark, where).collect()] == [("a", "First")]
    for command in (["rename", "zz", "x"], ["delete", "zz"], ["query", "  "]):
        with pytest.raises(SystemExit):
            main(["--folder", str(tmp_path), *command])
    given = iter(["1:13, 73", "", "5", " later "])
    monkeypatch.setattr("builtins.input", lambda _: next(given))
    notes = f"{tmp_path}/notes.json"
    main(["--folder", str(tmp_path), "annotate", "one", "--output", notes, "--queries", "q1"])
    main(["--folder", str(tmp_path), "annotate", "one", "--output", notes, "--queries", "q1", "q2"])
    rows = json_files.annotations(spark, notes).orderBy("pos").collect()
    assert [(r["query"], r.relevant_timestamps, r.notes, r.video_path) for r in rows] == [("q1", [73.0, 73.0], "", "/one.mp4"), ("q2", [5.0], "later", "/one.mp4")]
    main(["--folder", str(tmp_path), "list"])
    assert "First" in capsys.readouterr().out


def test_questions_need_the_models_of_the_index(spark, tmp_path):
    from types import SimpleNamespace

    from cuepoint import __main__ as cli
    from cuepoint.adapters import HashedWords

    folder = str(tmp_path)
    args = lambda **given: SimpleNamespace(**{"folder": folder, "frame_model": None, "text_model": None, "models": None} | given)
    stub = "cuepoint.adapters:HashedWords"
    for given in ({}, {"frame_model": stub}, {"text_model": stub}):
        with pytest.raises(SystemExit, match="name --"):
            cli._embedders(spark, args(**given))
    assert cli._embedders(spark, args(frame_model=stub, text_model=stub)) == (HashedWords, HashedWords)
    cli.stub_models = SimpleNamespace(question_vectors=HashedWords, text_vectors=HashedWords)
    name = "cuepoint.__main__:stub_models"
    for _ in range(2):
        cli._note_models(spark, args(models=name))
    with pytest.raises(SystemExit, match="was made with"):
        cli._note_models(spark, args(models="other:models"))
    assert cli._embedders(spark, args()) == (HashedWords, HashedWords)
    cli.stub_models.question_vectors = None
    with pytest.raises(SystemExit, match="name --frame-model:"):
        cli._embedders(spark, args())
    del cli.stub_models


def test_best_of_batch():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        group, sims, ids = rng.integers(0, 4, n), rng.integers(0, 5, n) / 4, rng.permutation(n)
        got = sorted(search._best(group, sims, 3, pa.array(ids)).tolist())
        expected = []
        for g in range(4):
            expected += sorted((i for i in range(n) if group[i] == g), key=lambda i: (-sims[i], ids[i]))[:3]
        assert got == sorted(expected)
