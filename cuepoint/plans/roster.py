"""Registered queries: each operator on stand-ins among the synthetic tables.

Even vectors are a frame index and odd ones a transcript index, labels are videos and vec_id is the
time line; every vector whose id is divisible by 20 is a query. Events are a user's frames at ``value`` seconds, turns of
conversations are speech. Thresholds suit these data; the library's defaults are those of ``Settings``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as X
from ..functions import vectors as V
from ..operators import context, folds, metrics, registry, search, timeline
from ..session import table
from ..shared import scratch_path, written
from ..sinks import tables
from ..sinks.log import Log
from ..sources import json_files
from ..sources.frames import frame_table
from . import ask

FIXTURE = replace(DEFAULT, score_threshold=0.15, video_gate=0.15)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("video"), F.col("vec_id").cast("double").alias("timestamp"), "embedding")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _vectors(spark, d)
    asked = _queries(spark, d).select("query_id", F.col("vector").alias("frame_vector"), F.col("vector").alias("transcript_vector"))
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), asked


def _union(spark: SparkSession, d: str) -> DataFrame:
    frames, transcript, asked = _two(spark, d)
    return search.union_results(frames, transcript, asked, keep_self=False)


def _hybrid(spark: SparkSession, d: str, keys: list[str] | None = None) -> DataFrame:
    frames, transcript, asked = _two(spark, d)
    return search.hybrid(frames, transcript, asked, keys, FIXTURE, keep_self=False)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("video_hash"), "event_type", F.col("value").alias("timestamp"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Speech segments: 15 characters take a second."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("video_hash"), F.col("turn").alias("pos"), "role", "text")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("video_hash").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumn("start", before / 15).withColumn("end", (before + F.length("text")) / 15)


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    found = search.nearest(_vectors(spark, d), _queries(spark, d), 10, keep_self=False)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"))


def knn_topk_per_video(spark: SparkSession, d: str) -> DataFrame:
    found = search.nearest(_vectors(spark, d), _queries(spark, d), 10, ["video"], keep_self=False)
    return found.select("query_id", "video", "rank", F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"))


def weighted_union(spark: SparkSession, d: str) -> DataFrame:
    return _union(spark, d).select("query_id", "ord", F.col("id").alias("vec_id"), "source", "timestamp", "score")


def anchored_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("score", ((F.col("event_id") * 37) % 101).cast("double"))
    grouped = folds.anchored_groups(rows, ["video_hash"], "timestamp", ["event_id"], 30.0)
    best = folds.best_of_groups(grouped, ["video_hash"], F.col("score"), "timestamp", ["event_id"])
    return best.select(F.col("video_hash").alias("user_id"), "grp", "anchor", "event_id", "timestamp", "score")


def _dynamic(threshold: float) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        kept = search.dynamic_k(_union(spark, d), ["query_id"], threshold)
        return kept.select("query_id", "place", F.col("id").alias("vec_id"), "source", "score")

    return run


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "place", F.col("id").alias("vec_id"), "source", "timestamp", "score")


def range_search(spark: SparkSession, d: str) -> DataFrame:
    kept = search.in_range(_hybrid(spark, d), 100.0, 400.0)
    return kept.select("query_id", "place", F.col("id").alias("vec_id"), "timestamp", "score", "dynamic_k")


def cross_video_top(spark: SparkSession, d: str) -> DataFrame:
    best = search.top_videos(_hybrid(spark, d, ["video"]), "video", FIXTURE.video_gate, FIXTURE.top_videos)
    return best.select("query_id", "place", "video", "best_score", "n_results")


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of each user's time line: 20 s apart, some short, with gaps."""
    users = _events(spark, d).select("video_hash").distinct()
    n = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n")
    length = F.element_at(F.array(*map(F.lit, (20.0, 1.5, 15.0, 18.0))), F.pmod(F.col("n"), F.lit(4)) + 1)
    cuts = users.select("video_hash", n).select("video_hash", (F.col("n") * 20.0).alias("start_sec"), (F.col("n") * 20.0 + length).alias("end_sec"))
    return timeline.tidy_scenes(cuts, users.withColumn("duration_sec", F.lit(500.0)))


def scene_lookup(spark: SparkSession, d: str) -> DataFrame:
    return timeline.with_scenes(_events(spark, d), _scenes(spark, d)).select("event_id", "scene_id")


def scene_changes(spark: SparkSession, d: str) -> DataFrame:
    frames = timeline.with_scenes(_events(spark, d), _scenes(spark, d))
    runs = timeline.scene_runs(frames, ["video_hash"], ["timestamp", "event_id"])
    return runs.groupBy(F.col("video_hash").alias("user_id")).agg(F.count("*").alias("n_frames"), F.count_if("changed").alias("n_changes"), F.max("scene_run").alias("last_run"))


def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("video_hash").orderBy("timestamp", "event_id")) - 1
    frames = _events(spark, d).withColumn("frame_idx", index).drop("timestamp")
    kept = timeline.sample_frames(frames, F.lit(2.5), 1.0, 2.0, 40.0)
    return kept.select(F.col("video_hash").alias("user_id"), "event_id", "frame_idx", "timestamp")


def _named_frames() -> Callable:
    """A decoder whose pictures say which frame of which recording they are."""
    return lambda path, first, last, step: ((i, f"{path}@{i}".encode()) for i in range(first, last + 1, step))


def frame_scan(spark: SparkSession, d: str) -> DataFrame:
    """A recording for each user, ten frames for each event, through the data source; both filters reach its reader."""
    counts = table(spark, d, "events").groupBy("user_id").agg((F.count("*") * 10).cast("int").alias("total_frames"))
    videos = counts.select(F.col("user_id").cast("string").alias("video_hash"), F.concat(F.lit("user-"), "user_id").alias("path"), F.lit(2.5).cast("double").alias("fps"), "total_frames")
    read = frame_table(videos, _named_frames, start_sec=2.0).filter("timestamp >= 20 AND frame_idx < 400")
    return read.select(F.col("video_hash").cast("bigint").alias("user_id"), "frame_idx", "timestamp", F.col("frame").cast("string").alias("picture"))


def scene_renumber(spark: SparkSession, d: str) -> DataFrame:
    after = F.lead("timestamp").over(Window.partitionBy("video_hash").orderBy("timestamp", "event_id"))
    rows = _events(spark, d).withColumn("end_sec", after)
    cuts = rows.filter("end_sec is not null").select("video_hash", F.col("timestamp").alias("start_sec"), "end_sec")
    videos = rows.groupBy("video_hash").agg(F.max("timestamp").alias("duration_sec"))
    return timeline.tidy_scenes(cuts, videos).select(F.col("video_hash").alias("user_id"), "scene_id", "start_sec", "end_sec")


def rolling_threshold(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("timestamp").over(Window.partitionBy("video_hash").orderBy("timestamp", "event_id"))
    scored = _events(spark, d).withColumn("score", 1 - F.abs(F.col("timestamp") - before) / 100).filter("score is not null")
    out = timeline.rolling_threshold(scored, ["video_hash"], ["timestamp", "event_id"])
    return out.select("event_id", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), F.round("threshold", 8).alias("threshold"))


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    return folds.semantic_filter(_vectors(spark, d).drop("timestamp"), ["video"], ["id"], threshold=0.10)


def semantic_filter(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d).select(F.col("id").alias("vec_id"), "keep", F.round("score", 6).alias("score"))


def semantic_filter_cut(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as one recording, folded in four parts."""
    one = _vectors(spark, d).drop("timestamp").withColumn("video", F.lit(0))
    out = folds.semantic_filter(one, ["video"], ["id"], threshold=0.10, parts=4)
    return out.select(F.col("id").alias("vec_id"), "keep", F.round("score", 6).alias("score"))


def adaptive_filter(spark: SparkSession, d: str, parts: int = 0) -> DataFrame:
    frames = _vectors(spark, d).withColumn("scene_id", F.when(F.pmod(F.floor(F.col("id") / 40), F.lit(3)) == 2, -1).otherwise(F.floor(F.col("id") / 40)).cast("int"))
    if parts:
        frames = frames.withColumn("video", F.lit(0))
    out = folds.adaptive_filter(frames, ["video"], ["id"], "embedding", multiplier=0.9, floor=-0.15, ceiling=0.15, parts=parts)
    return out.select(F.col("id").alias("vec_id"), "keep", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "reset")


def adaptive_filter_cut(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as one recording, folded in four parts."""
    return adaptive_filter(spark, d, parts=4)


def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    return folds.filter_stats(_semantic(spark, d), ["video"])


def transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    return timeline.chunk_transcript(_turns(spark, d)).select(F.col("video_hash").alias("conv_id"), "chunk_id", "start_time", "end_time", "text")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select(F.col("video_hash").alias("conv_id"), F.col("start").alias("timestamp"), F.col("pos").alias("ord"), "text")
    return context.budgeted_context(rows, ["conv_id"], 500)


#: Replies of a re-ranking model, by conversation; some are not what was asked for.
REPLIES = ('{"selected": [2, 0], "reasoning": "x"}', '{"selected": [0, 9, 1.7, true, "x"]}', "no json", '```json\n{"selected": [3, 3, -0.5]}\n```', '{"selected": []}', '{"selected": 4}', '{"other": 1}', "[1, 2]")


def rerank_gather(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select(F.col("video_hash").alias("conv_id"), "pos", (F.length("text") % 17).cast("double").alias("score"))
    replies = rows.select("conv_id").distinct().withColumn("reply", F.element_at(F.array(*map(F.lit, REPLIES)), F.pmod("conv_id", F.lit(len(REPLIES))).cast("int") + 1))
    out = context.gather(rows, replies, ["conv_id"], [F.col("pos")])
    return out.select("conv_id", "place", F.col("pos").alias("turn"))


def rerank_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select(F.col("video_hash").alias("conv_id"), "pos", F.col("start").alias("timestamp"), F.col("role").alias("source"), "text")
    return context.candidate_lines(rows, ["conv_id"], ["pos"], 60)


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    times = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("event_id", "timestamp")))), lambda x: x["timestamp"])
    return rows.groupBy(F.col("video_hash").alias("user_id")).agg(times("view").alias("retrieved"), times("purchase").alias("relevant"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.rounded(metrics.query_metrics(_ranking(spark, d), 5, 10.0))
    return out.select("user_id", F.size("retrieved_timestamps").alias("n_retrieved"), "precision_at_k", "recall_at_k", "reciprocal_rank", "hit_at_k")


def eval_macro(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro(metrics.query_metrics(_ranking(spark, d), 5, 10.0))


def clock_format(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("timestamp") * 37
    return _events(spark, d).select("event_id", X.minutes_clock(seconds).alias("minutes_clock"), X.hours_clock(seconds).alias("hours_clock"), X.clock_seconds(X.hours_clock(seconds)).alias("seconds"))


def parse_timestamps(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    written = (
        F.when(n % 5 == 0, n.cast("string"))
        .when(n % 5 == 1, F.concat(F.lit("1:"), n % 60, F.lit(", "), n % 7, F.lit(":26.5")))
        .when(n % 5 == 2, F.concat(F.lit("1:"), n % 60, F.lit(":05")))
        .when(n % 5 == 3, F.concat(n, F.lit(" , x,, 1:2:3:4")))
        .otherwise(F.concat(F.lit("a:1, "), n % 9, F.lit(":zz,"), n, F.lit(".25")))
    )
    times = X.parse_times(written)
    return _events(spark, d).select("event_id", F.size(times).alias("n_times"), F.round(F.aggregate(times, F.lit(0.0), lambda a, x: a + x), 1).alias("total"))


def video_hash(spark: SparkSession, d: str) -> DataFrame:
    h = X.video_hash(F.col("source"), F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", h.alias("video_hash"), X.frame_id(h, F.col("doc_id")).alias("frame_id"), X.chunk_id(h, F.col("doc_id")).alias("chunk_id"))


def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("value"), F.lit(0).alias("load_seq"))
    later = base.filter("c_custkey % 3 = 0").withColumn("value", F.col("value") + 1).withColumn("load_seq", F.lit(1))
    latest = base.filter("c_custkey % 6 = 0").withColumn("value", F.col("value") + 2).withColumn("load_seq", F.lit(2))
    new = base.filter("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000).withColumn("load_seq", F.lit(1))
    return registry.upsert(base, later.unionByName(latest).unionByName(new), ["c_custkey"], F.col("load_seq")).withColumn("value", F.round("value", 2))


def upsert_log(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("value"), F.lit(0).alias("load_seq"))
    customers = Log(spark, scratch_path(spark, "customers"), base.schema, ["c_custkey"])
    customers.append(base)
    raised = lambda every, by: base.filter(F.col("c_custkey") % every == 0).withColumn("value", F.col("value") + by).withColumn("load_seq", F.lit(by))
    # two rows of a key in one commit, a batch that comes twice, deleted keys of which one part comes back
    for _ in range(2):
        customers.append(raised(3, 1).unionByName(raised(6, 2)), sequence=F.col("load_seq"), stream="loads", batch=0)
    customers.append(gone=base.filter("c_custkey % 5 = 0"))
    customers.compact()
    customers.append(raised(15, 3))
    return customers.read().withColumn("value", F.round("value", 2))


def registry_rename(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("video_name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise("").alias("custom_name"))
    renamed = registry.rename(rows, "c_custkey", 7, "  Lecture seven \t")
    return renamed.select("c_custkey", "custom_name", X.display_name(F.col("custom_name"), F.col("video_name")).alias("display_name"))


def registry_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    kept = registry.delete(table(spark, d, "orders"), gone, "o_custkey")
    return kept.select("o_orderkey", "o_custkey")


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return registry.not_done(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


#: Names to look for among the parts.
NAMES = ("small ring", "red widget.v2.mp4", "ring", "a hot gear in motion.mkv", "nothing like it")


def fuzzy_name_match(spark: SparkSession, d: str) -> DataFrame:
    return registry.match_names(table(spark, d, "part"), [*NAMES], "p_name", "p_partkey")


def fuzzy_name_table(spark: SparkSession, d: str) -> DataFrame:
    """Names from a table: pieces of part names, part names with more behind them, and brands."""
    parts = table(spark, d, "part")
    piece = F.expr("substring(p_name, CAST(3 + p_partkey % 4 AS INT), CAST(3 + p_partkey % 9 AS INT))")
    wanted = parts.select(F.explode(F.array(piece, F.concat("p_name", F.lit(" take "), "p_partkey", F.lit(".mkv")), F.col("p_brand"))).alias("wanted"))
    return registry.match_name_table(parts, wanted, "p_name", "p_partkey")


def answer_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = _hybrid(spark, d).withColumn("text", F.when(F.col("source") == "transcript", F.concat(F.lit("t"), "id"))).withColumn("frame_path", F.when(F.col("source") == "frames", F.concat(F.lit("f"), "id")))
    parts = context.assemble(rows, ["query_id"])
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    whole = F.array_join(F.transform("timestamps", lambda t: t.cast("bigint").cast("string")), ",")
    return parts.select("query_id", whole.alias("timestamps"), joined("keyframe_paths").alias("keyframe_paths"), joined("transcript_used").alias("transcript_used"), F.size("sources").alias("n_sources"))


def answer_view(spark: SparkSession, d: str) -> DataFrame:
    """What a chat shows of each question's answer: its text, the times and the sources with clocks and scores."""
    rows = _hybrid(spark, d).withColumn("text", F.when(F.col("source") == "transcript", F.concat(F.lit("t"), "id"))).withColumn("frame_path", F.when(F.col("source") == "frames", F.concat(F.lit("f"), "id")))
    answered = context.assemble(rows, ["query_id"]).select(F.col("query_id").cast("string").alias("query"), F.concat(F.lit("about "), "query_id").alias("response_text"), "timestamps", "keyframe_paths", "sources")
    shown = ask.answer_view(answered)
    return shown.select("query", "response_text", *[F.array_join(c, ", ").alias(c) for c in ("times", "keyframe_paths", "sources")])


def search_response(spark: SparkSession, d: str) -> DataFrame:
    # one search: both the candidates and the results are made of it
    found = written(_union(spark, d), "candidates")
    out = search.response(search.picked(found, ["query_id"], FIXTURE), found, _queries(spark, d))
    return out.select("query_id", "frame_candidates", "transcript_candidates", "dynamic_k")


def score_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = folds.score_lists(_semantic(spark, d), ["video"], ["id"], ["score"])
    whole = F.transform("scores", lambda x: F.round(x * 10000).cast("bigint").cast("string"))
    return lists.select("video", F.array_join(whole, ",").alias("scores"))


def answer_gate(spark: SparkSession, d: str) -> DataFrame:
    kept = context.gated(_hybrid(spark, d, ["video"]), ["query_id", "video"], 0.20)
    return kept.groupBy("query_id", "video").agg(F.count("*").alias("n_results"), F.max("score").alias("best_score"))


def answer_fallback(spark: SparkSession, d: str) -> DataFrame:
    spoken = F.when(F.col("source") == "transcript", F.concat(F.lit("words at "), "id")).otherwise("")
    rows = _hybrid(spark, d).withColumn("text", spoken).withColumn("frame_path", F.lit(""))
    queries = _queries(spark, d).select("query_id", F.lit("?").alias("query")).unionByName(spark.createDataFrame([(-1, "?")], "query_id bigint, query string"))
    return context.answers(rows, queries, ["query_id"], None).select("query_id", "response_text", F.size("sources").alias("n_sources"))


def shown_images(spark: SparkSession, d: str) -> DataFrame:
    rows = _union(spark, d).withColumn("place", F.col("ord")).withColumn("text", F.lit("")).withColumn("frame_path", F.concat(F.lit("f"), "id"))
    files = _vectors(spark, d).filter("id % 4 <> 0").select(F.concat(F.lit("f"), "id").alias("path"))
    return context.shown_images(context.assemble(rows, ["query_id"]), files, ["query_id"]).select("query_id", "place", "path")


def library_listing(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = registry.ranked(table(spark, d, "orders").select("o_orderkey", "o_totalprice", day.alias("day")), F.col("day"), [F.col("o_orderkey")])
    pct = F.when(F.col("o_orderkey") % 7 == 0, F.lit(-1.0)).otherwise(F.floor(F.col("o_totalprice") / 10000).cast("double"))
    return rows.select("o_orderkey", "place", "day", F.pmod(F.col("place") - 1, F.lit(3)).alias("grid_column"), X.shown_pct(pct).alias("reduction"))


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both indexes in the shape of the search tables, and the questions with their texts."""
    frames, transcript, asked = _two(spark, d)
    shaped = lambda t: t.withColumn("video_hash", F.col("video").cast("string")).drop("video")
    frames = shaped(frames).withColumn("frame_path", F.concat(F.lit("f"), "id"))
    return frames, shaped(transcript).withColumn("text", F.concat(F.lit("words at "), "id")), asked.withColumn("query", F.concat(F.lit("q"), "query_id"))


def ask_video(spark: SparkSession, d: str) -> DataFrame:
    frames, transcript, asked = _library(spark, d)
    # a blank question is left out
    asked = asked.withColumn("query", F.when(F.col("query_id") % 60 == 0, " \t").otherwise(F.col("query")))
    return ask.ask(frames, transcript, asked, "3", None, None, FIXTURE).select("query_id", "response_text", F.size("sources").alias("n_sources"))


def ask_library(spark: SparkSession, d: str) -> DataFrame:
    frames, transcript, asked = _library(spark, d)
    videos = frames.select("video_hash").distinct().withColumn("date_indexed", F.concat(F.lit("2024-01-0"), F.col("video_hash").cast("int") % 3))
    out = ask.ask_library(frames, transcript, asked, videos, None, None, FIXTURE)
    return out.select("query_id", "video_hash", "video_place", "best_score", "response_text", F.size("sources").alias("n_sources"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    frames, transcript, asked = _library(spark, d)
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("video_hash"))
    times = F.array((F.col("query_id") + 10).cast("double"), (F.col("query_id") + 300).cast("double"))
    annotated = asked.join(own, "query_id").select("video_hash", F.col("query_id").alias("pos"), "query", times.alias("relevant_timestamps"), F.lit(30.0).alias("tolerance"))
    return ask.evaluate(annotated, frames, transcript, asked.select("query", "frame_vector", "transcript_vector"), None, 5, FIXTURE)


def evaluate_queries(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("query", "video_hash", F.size("retrieved_timestamps").alias("n_retrieved"), "precision_at_k", "recall_at_k", "reciprocal_rank", "hit_at_k")


def evaluate_report(spark: SparkSession, d: str) -> DataFrame:
    return ask.means(_evaluated(spark, d), 5).withColumn("n_results", F.col("num_queries").cast("int"))


def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _evaluated(spark, d)
    return ask.summary_lines(rows, ask.means(rows, 5))


def video_duration(spark: SparkSession, d: str) -> DataFrame:
    fps = (F.col("doc_id") % 4) * 7.5
    return table(spark, d, "documents").select("doc_id", F.round(timeline.duration(F.col("n_chars"), fps), 6).alias("duration_sec"))


def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("video_hash"))
    return json_files.lookup(rows, "BUILDING")


def collection_sizes(spark: SparkSession, d: str) -> DataFrame:
    frames, transcript, _ = _library(spark, d)
    return tables.sizes(frames, transcript)


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh vector is made zero, and has none."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("id") % 7))
    unit = _vectors(spark, d).withColumn("unit", V.normalised(scaled))
    return unit.select(F.col("id").alias("vec_id"), F.round(V.dot(F.col("unit"), F.col("unit")), 6).alias("length"), F.round(F.element_at("unit", 1), 6).alias("first"))


def static_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.static_url(F.col("url")).alias("link"))


def asked_queries(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, " \t").when(F.col("turn") % 5 == 1, None).otherwise(F.col("text"))
    return search.asked(table(spark, d, "conversations").withColumn("query", text)).select("conv_id", "turn")


def pending_videos(spark: SparkSession, d: str) -> DataFrame:
    incoming = table(spark, d, "documents").select(F.col("doc_id").alias("video_hash"), "source")
    known = table(spark, d, "labels").select(F.col("doc_id").alias("video_hash"))
    both = registry.pending(incoming, known).withColumn("forced", F.lit(False)).unionByName(registry.pending(incoming, known, force=True).withColumn("forced", F.lit(True)))
    return both.groupBy("source", "forced").agg(F.count("*").alias("videos"))


def registry_register(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("video_hash"), F.col("c_name").alias("video_name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise("").alias("custom_name"), F.lit(1).alias("total_chunks"))
    again = rows.filter("video_hash % 3 = 0").select("video_hash", F.concat("video_name", F.lit(".mp4")).alias("video_name"), F.lit(2).alias("total_chunks"))
    new = rows.filter("video_hash % 10 = 0").select((F.col("video_hash") + 10_000_000).alias("video_hash"), "video_name", F.lit(3).alias("total_chunks"))
    return registry.register(rows, again.unionByName(new)).select("video_hash", "video_name", "custom_name", "total_chunks")


def annotate_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source are annotated already, those of another are given now."""
    docs = table(spark, d, "documents")
    video = spark.createDataFrame([("v", "lecture.mp4", "/lecture.mp4")], "video_hash string, video_name string, video_path string")
    about = [F.lit("v").alias("video_hash"), F.lit("lecture.mp4").alias("video_name"), F.lit("/lecture.mp4").alias("video_path"), F.lit("2024-01-01T00:00:00").alias("annotated_at"), F.lit(30.0).alias("tolerance")]
    old = docs.filter("source = 'src1'").select(*about, F.col("doc_id").alias("pos"), F.concat(F.lit("q"), F.col("doc_id") % 50).alias("query"), F.array(F.lit(1.0)).alias("relevant_timestamps"), F.lit("").alias("notes"))
    given = docs.filter("source = 'src2'").select(F.col("doc_id").alias("pos"), F.concat(F.lit("q"), F.col("doc_id") % 60).alias("query"), F.concat(F.col("doc_id") % 60, F.lit(":05, "), F.col("doc_id") % 7).alias("times"), F.lit(" n ").alias("notes"))
    out = ask.annotate(video, old, given, "2024-02-02T00:00:00")
    entry = lambda a: F.concat(a["query"], F.lit("@"), F.aggregate(a["relevant_timestamps"], F.lit(0.0), lambda t, x: t + x).cast("bigint"), a["notes"])
    return out.select("video_path", "annotated_at", "timestamp_tolerance_sec", "total_annotations", F.array_join(F.transform("annotations", entry), ",").alias("entries"))


def shown_annotations(spark: SparkSession, d: str) -> DataFrame:
    times = F.array(F.col("n_chars").cast("double"), F.col("doc_id") * 61.5)
    return ask.shown_annotations(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("query"), times.alias("relevant_timestamps"), F.col("source").alias("notes")))


def library_view(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    unknown = lambda c: F.when(n % 7 == 0, -1).otherwise(c)
    rows = table(spark, d, "orders").select(
        n.cast("string").alias("video_hash"), F.concat(F.lit("v"), n, F.lit(".mp4")).alias("video_name"), F.when(n % 4 == 0, F.col("o_orderpriority")).otherwise("").alias("custom_name"),
        F.concat(F.lit("/data/"), n, F.lit("/v.mp4")).alias("video_path"), F.when(n % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("date_indexed"),
        unknown(n % 100).cast("int").alias("total_keyframes"), (n % 50).cast("int").alias("total_chunks"), unknown(n % 90).cast("double").alias("ssim_reduction_pct"), (n % 33).cast("double").alias("clip_reduction_pct"),
    )
    return ask.library_view(rows)


def frame_ssim(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as gray pictures of 8 by 8, each against the one before of its video."""
    level = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("int")), 2, "0"))
    frames = _vectors(spark, d).withColumn("frame", F.unhex(F.array_join(level, "")))
    pairs = frames.withColumn("before", F.lag("frame").over(Window.partitionBy("video").orderBy("id")))
    return folds.frame_similarity(pairs, "before", "frame", 8, 8, side=8).select(F.col("id").alias("vec_id"), F.round("ssim", 6).alias("ssim"))


def gray_levels(spark: SparkSession, d: str) -> DataFrame:
    """The first 63 terms of vectors as BGR pictures of 3 by 7."""
    level = F.transform(F.slice("embedding", 1, 63), lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("int")), 2, "0"))
    frames = _vectors(spark, d).withColumn("frame", F.unhex(F.array_join(level, "")))
    return folds.gray_frames(frames, "frame", 3, 7).select(F.col("id").alias("vec_id"), F.lower(F.hex("gray")).alias("shades"))


def prompt_images(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the prompts of a model that takes pictures; every fourth picture is missing."""
    rows = _union(spark, d).withColumn("place", F.col("ord")).withColumn("text", F.lit("")).withColumn("frame_path", F.concat(F.lit("f"), "id"))
    spoken = F.when(F.col("query_id") % 40 == 0, F.concat(F.lit("c"), "query_id")).otherwise(" ")
    parts = context.assemble(rows, ["query_id"]).withColumn("context", spoken).withColumn("query", F.concat(F.lit("q"), "query_id"))
    pictures = _vectors(spark, d).filter("id % 4 <> 0").select(F.concat(F.lit("f"), "id").alias("frame_path"), F.col("id").cast("string").cast("binary").alias("image"))
    loaded = context.loaded_parts(context.prompt_parts(parts), ["query_id"], pictures).select("query_id", F.posexplode("prompt").alias("n", "p"))
    return loaded.select("query_id", "n", "p.kind", F.element_at(F.split("p.value", "\n"), -1).alias("value"), F.coalesce(F.length("p.image"), F.lit(0)).alias("n_bytes"))


def keyframe_paths(spark: SparkSession, d: str) -> DataFrame:
    name = X.frame_file((F.col("doc_id") % 1000).cast("int"), F.col("n_chars") / 7)
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", F.lit("keyframes"), "source", name).alias("frame_path"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "knn_topk": knn_topk,
        "knn_topk_per_video": knn_topk_per_video,
        "weighted_union": weighted_union,
        "anchored_dedup": anchored_dedup,
        "dynamic_k_threshold": _dynamic(0.15),
        "dynamic_k_fallback": _dynamic(0.20),
        "hybrid_search": hybrid_search,
        "range_search": range_search,
        "cross_video_top": cross_video_top,
        "scene_lookup": scene_lookup,
        "scene_changes": scene_changes,
        "frame_sampling": frame_sampling,
        "frame_scan": frame_scan,
        "scene_renumber": scene_renumber,
        "rolling_threshold": rolling_threshold,
        "semantic_filter": semantic_filter,
        "adaptive_filter": adaptive_filter,
        "semantic_filter_cut": semantic_filter_cut,
        "adaptive_filter_cut": adaptive_filter_cut,
        "filter_stats": filter_stats,
        "transcript_chunks": transcript_chunks,
        "context_budget": context_budget,
        "rerank_gather": rerank_gather,
        "rerank_prompt": rerank_prompt,
        "eval_metrics": eval_metrics,
        "eval_macro": eval_macro,
        "clock_format": clock_format,
        "parse_timestamps": parse_timestamps,
        "video_hash": video_hash,
        "registry_upsert": registry_upsert,
        "registry_rename": registry_rename,
        "registry_delete": registry_delete,
        "resume_anti": resume_anti,
        "fuzzy_name_match": fuzzy_name_match,
        "fuzzy_name_table": fuzzy_name_table,
        "answer_assembly": answer_assembly,
        "answer_view": answer_view,
        "library_listing": library_listing,
        "search_response": search_response,
        "score_lists": score_lists,
        "answer_gate": answer_gate,
        "answer_fallback": answer_fallback,
        "shown_images": shown_images,
        "ask_video": ask_video,
        "ask_library": ask_library,
        "evaluate_queries": evaluate_queries,
        "evaluate_report": evaluate_report,
        "summary_lines": summary_lines,
        "video_duration": video_duration,
        "registry_lookup": registry_lookup,
        "collection_sizes": collection_sizes,
        "unit_vectors": unit_vectors,
        "static_links": static_links,
        "asked_queries": asked_queries,
        "pending_videos": pending_videos,
        "registry_register": registry_register,
        "annotate_resumed": annotate_resumed,
        "shown_annotations": shown_annotations,
        "library_view": library_view,
        "upsert_log": upsert_log,
        "frame_ssim": frame_ssim,
        "gray_levels": gray_levels,
        "prompt_images": prompt_images,
        "keyframe_paths": keyframe_paths,
    }
