"""Whole queries: search, questions to one recording and to the library, evaluation, annotation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import display_name, hours_clock, parse_times, shown_pct, static_url, strip
from ..operators import context, metrics, registry, search
from ..shared import written
from ..sinks import tables

Model = Callable[[str], str] | None


def search_video(frames: DataFrame, transcript: DataFrame, queries: DataFrame, video_hash: str, settings: Settings = DEFAULT) -> DataFrame:
    """Hybrid search in one recording; ``queries`` has query_id, frame_vector, transcript_vector."""
    own = lambda t: t.filter(F.col("video_hash") == video_hash)
    return search.hybrid(own(frames), own(transcript), queries, settings=settings)


def search_range(frames: DataFrame, transcript: DataFrame, queries: DataFrame, video_hash: str, start: float, end: float, settings: Settings = DEFAULT) -> DataFrame:
    """A finished search cut to a range of times; it can be shorter than the least k, and empty."""
    return search.in_range(search_video(frames, transcript, queries, video_hash, settings), start, end)


def search_library(frames: DataFrame, transcript: DataFrame, queries: DataFrame, videos: DataFrame, settings: Settings = DEFAULT, gate: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The best recordings of each query and their results, from one search over all partitions, which is written."""
    results = written(search.hybrid(frames, transcript, queries, ["video_hash"], settings), "search-results")
    dated = results.join(videos.select("video_hash", F.coalesce("date_indexed", F.lit("")).alias("date_indexed")), "video_hash")
    best = dated.groupBy("query_id", "video_hash", "date_indexed").agg(F.max("score").alias("best_score")).filter(F.col("best_score") >= (settings.video_gate if gate is None else gate))
    order = Window.partitionBy("query_id").orderBy(F.col("best_score").desc(), F.col("date_indexed").desc(), "video_hash")
    top = best.withColumn("video_place", F.row_number().over(order)).filter(F.col("video_place") <= settings.top_videos)
    info = top.join(videos.drop("date_indexed"), "video_hash", "left")
    return info, results.join(top.select("query_id", "video_hash", "video_place", "best_score"), ["query_id", "video_hash"])


def _picked(results: DataFrame, queries: DataFrame, keys: list[str], reranker: Model, settings: Settings, ledger: str | None) -> DataFrame:
    """Re-ranked results. Both they and what was found are written: later steps read them several times."""
    rows = written(_described(results).join(queries.select("query_id", "query"), "query_id"), "found-rows")
    return written(context.rerank(rows, keys, [F.col("place")], reranker, settings=settings, ledger=ledger), "picked-rows")


def ask(frames: DataFrame, transcript: DataFrame, queries: DataFrame, video_hash: str, reranker: Model, answerer: Model, settings: Settings = DEFAULT, model_name: str = "", pictures: DataFrame | None = None, ledger: str | None = None) -> DataFrame:
    """Answers about one recording; ``queries`` also has query, the text. Blank questions are left out.

    Questions, what is found, what is picked and the models' replies are written as they come, so each is
    made once. ``ledger`` is a folder that keeps replies for later runs.
    """
    queries = written(search.asked(queries), "questions")
    picked = _picked(search_video(frames, transcript, queries, video_hash, settings), queries, ["query_id"], reranker, settings, _of(ledger, "rerank"))
    return context.answers(picked, queries.select("query_id", "query"), ["query_id"], answerer, model_name, settings, pictures, _of(ledger, "answer"))


def ask_library(frames: DataFrame, transcript: DataFrame, queries: DataFrame, videos: DataFrame, reranker: Model, answerer: Model, settings: Settings = DEFAULT, model_name: str = "", pictures: DataFrame | None = None, ledger: str | None = None) -> DataFrame:
    """Answers about the best recordings of each query, with their ``video_place``; those whose results don't reach
    the gate are left out. Written step by step as in ``ask``; the order of rows is the caller's."""
    keys, queries = ["query_id", "video_hash"], written(search.asked(queries), "questions")
    top, results = search_library(frames, transcript, queries, videos, settings)
    picked = context.gated(_picked(results, queries, keys, reranker, settings, _of(ledger, "rerank")), keys, settings.answer_gate)
    asked = picked.select(*keys).distinct().join(queries.select("query_id", "query"), "query_id")
    answered = context.answers(picked, asked, keys, answerer, model_name, settings, pictures, _of(ledger, "answer"))
    return answered.join(top.select(*keys, "video_place", "best_score"), keys)


def _of(ledger: str | None, kind: str) -> str | None:
    return ledger and f"{ledger.rstrip('/')}/{kind}"


def _described(results: DataFrame) -> DataFrame:
    """Results with text and frame_path, empty where an index has none."""
    for column in ("text", "frame_path"):
        results = results.withColumn(column, F.coalesce(column, F.lit("")) if column in results.columns else F.lit(""))
    return results


def evaluate(annotated: DataFrame, frames: DataFrame, transcript: DataFrame, vectors: DataFrame, reranker: Model, k: int = 5, settings: Settings = DEFAULT, ledger: str | None = None) -> DataFrame:
    """A metrics row for each annotated query, written. ``vectors`` has query, frame_vector, transcript_vector.

    All queries are searched in one plan, each in its own recording. Re-ranking returns at most five rows, so precision at a larger
    k can't pass five over k.
    """
    queries = annotated.select(F.concat_ws(":", "video_hash", "pos").alias("query_id"), "video_hash", "query", "relevant_timestamps", "tolerance").join(vectors, "query", "left")
    queries = written(queries, "questions")
    picked = _picked(search.hybrid(frames, transcript, queries, settings=settings, own="video_hash"), queries, ["query_id"], reranker, settings, _of(ledger, "rerank"))
    retrieved = picked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "timestamp"))), lambda r: r["timestamp"]).alias("retrieved"))
    rows = queries.join(retrieved, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<double>")))
    measured = metrics.query_metrics(rows, k, settings.tolerance_sec, "retrieved", "relevant_timestamps")
    return written(metrics.rounded(measured), "evaluated")


def means(per_query: DataFrame, k: int) -> DataFrame:
    """The numbers of a report: means of the rounded metrics over all queries, none of which is gathered. Without queries there is none."""
    return metrics.macro(per_query).withColumn("k", F.lit(k))


def report(per_query: DataFrame, k: int) -> DataFrame:
    """The report of a file: ``means`` and all rows in one, as its format asks for; where that isn't wanted, ``means`` does. Without queries there is none."""
    columns = ["query", "retrieved_timestamps", "relevant_timestamps", "hits", "precision_at_k", "recall_at_k", "reciprocal_rank", "hit_at_k"]
    rows = per_query.agg(F.array_sort(F.collect_list(F.struct("query_id", F.struct(*columns).alias("r")))).alias("_r")).select(F.transform("_r", lambda r: r["r"]).alias("query_results"))
    return means(per_query, k).join(rows, F.size("query_results") > 0)


def summary_lines(per_query: DataFrame, means: DataFrame) -> DataFrame:
    """What a person reads of a report, a line a row."""
    one = per_query.select(F.concat(F.lit("  "), "query", F.lit(": P "), F.col("precision_at_k").cast("string"), F.lit(", R "), F.col("recall_at_k").cast("string")).alias("line"))
    total = means.select(F.concat(F.lit("mean P "), F.col("mean_precision_at_k").cast("string"), F.lit(", mean R "), F.col("mean_recall_at_k").cast("string"), F.lit(", MRR "), F.col("mrr").cast("string"), F.lit(", hit rate "), F.col("hit_rate_at_k").cast("string"), F.lit(" ("), "band", F.lit(")")).alias("line"))
    return one.unionByName(total)


def to_annotate(queries: DataFrame, done: DataFrame) -> DataFrame:
    return registry.not_done(queries, done)


def annotate(video: DataFrame, existing: DataFrame, given: DataFrame, annotated_at: str, tolerance: float = DEFAULT.tolerance_sec, resume: bool = True) -> DataFrame:
    """The one row of a video's annotation file: what is there and new entries (pos, query, times, notes).

    ``times`` is a comma list of clocks. On resuming, queries that are annotated already are left out;
    without, the file begins anew. ``video`` is its registry row.
    """
    old = existing if resume else existing.limit(0)
    fresh = to_annotate(given, old) if resume else given
    about = video.select("video_hash", "video_name", "video_path")
    new = fresh.crossJoin(F.broadcast(about.limit(1))).select("video_hash", "video_name", "video_path", F.lit(tolerance).alias("tolerance"), "pos", "query", parse_times(F.col("times")).alias("relevant_timestamps"), strip(F.coalesce("notes", F.lit(""))).alias("notes"))
    return tables.merged_annotations(old, new, annotated_at)


def shown_annotations(annotated: DataFrame) -> DataFrame:
    """Annotations with their times as clocks."""
    return annotated.select("query", F.array_join(F.transform("relevant_timestamps", hours_clock), ", ").alias("times"), "notes")


def library_view(rows: DataFrame, columns: int = 3) -> DataFrame:
    """What a page of the library shows of each recording, the newest first: place and column of its card, names, day,
    counts (N/A where unknown) and reductions."""
    newest = F.coalesce("date_indexed", F.lit(""))
    placed = registry.ranked(rows, newest, [F.col("video_hash")])
    count = lambda c: F.when(F.col(c) < 0, "N/A").otherwise(F.col(c).cast("string")).alias(c)
    return placed.select(
        "video_hash", "place", F.pmod(F.col("place") - 1, F.lit(columns)).alias("grid_column"), display_name(F.col("custom_name"), F.col("video_name")).alias("name"),
        F.substring(newest, 1, 10).alias("day"), count("total_keyframes"), count("total_chunks"), shown_pct(F.col("ssim_reduction_pct")).alias("ssim_reduction"),
        shown_pct(F.col("clip_reduction_pct")).alias("clip_reduction"), static_url(F.col("video_path")).alias("url"),
    )


def answer_view(answered: DataFrame) -> DataFrame:
    """What a chat shows of answers: the text, the times as clocks, and each source with its clock and score."""
    source = lambda x: F.concat(x["source"], F.lit(" at "), hours_clock(x["timestamp"]), F.lit(" ("), F.format_string("%.2f", x["score"]), F.lit(")"))
    return answered.select("query", "response_text", F.transform("timestamps", hours_clock).alias("times"), "keyframe_paths", F.transform("sources", source).alias("sources"))


def with_settings(**changes) -> Settings:
    return replace(DEFAULT, **changes)
