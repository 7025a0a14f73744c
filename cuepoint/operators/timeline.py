"""Scenes, sampling, windows and rolling statistics on a video's time line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(0.0)


def sample_step(native_fps: Column, fps: float) -> Column:
    """Every how many frames one is taken; halves round to even."""
    return F.greatest(F.lit(1), F.bround(native_fps / F.lit(float(fps))).cast("int"))


def sample_frames(frames: DataFrame, native_fps: Column, fps: float = 1.0, start_sec: float | None = None, end_sec: float | None = None, index: str = "frame_idx") -> DataFrame:
    """Frames on the sampling grid with ``timestamp``; a range starts at its first frame and ends inclusive."""
    first = F.floor(F.lit(start_sec) * native_fps).cast("long") if start_sec is not None else F.lit(0).cast("long")
    raw = F.col(index) / native_fps
    kept = (F.col(index) >= first) & (F.pmod(F.col(index) - first, sample_step(native_fps, fps)) == 0)
    if end_sec is not None:
        kept = kept & (raw <= end_sec)
    return frames.filter(kept).withColumn("timestamp", F.round(raw, 3))


def tidy_scenes(cuts: DataFrame, videos: DataFrame, min_sec: float = 2.0, key: str = "video_hash") -> DataFrame:
    """Scenes of at least ``min_sec`` numbered from 0 in each video; a video without any is one scene."""
    order = Window.partitionBy(key).orderBy("start_sec", "end_sec")
    kept = cuts.filter(F.col("end_sec") - F.col("start_sec") >= min_sec)
    numbered = kept.select(key, (F.row_number().over(order) - 1).alias("scene_id"), F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))
    whole = videos.join(numbered.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("scene_id"), F.lit(0.0).alias("start_sec"), F.round("duration_sec", 3).alias("end_sec"))
    return numbered.unionByName(whole)


def scene_at(ts: Column, scenes: Column) -> Column:
    """Number of the first scene that holds ``ts``, the last scene at its very end, else -1.

    ``scenes`` is the video's array of (scene_id, start_sec, end_sec) in order.
    """
    inside = F.filter(scenes, lambda s: (s["start_sec"] <= ts) & (ts < s["end_sec"]))
    last = F.try_element_at(scenes, F.lit(-1))
    return F.coalesce(F.try_element_at(inside, F.lit(1))["scene_id"], F.when(ts == last["end_sec"], last["scene_id"]), F.lit(-1))


def with_scenes(frames: DataFrame, scenes: DataFrame, ts: str = "timestamp", key: str = "video_hash") -> DataFrame:
    """``frames`` with ``scene_id``: joined by video to its array of scenes, so no row is multiplied."""
    lists = scenes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("scene_id", "start_sec", "end_sec"))).alias("_scenes"))
    return frames.join(lists, key, "left").withColumn("scene_id", F.coalesce(scene_at(F.col(ts), F.col("_scenes")), F.lit(-1))).drop("_scenes")


def scene_runs(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``frames`` with ``changed`` (another scene than the row before) and ``scene_run``, the number of changes so far."""
    window = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(F.lag("scene_id").over(window) != F.col("scene_id"), F.lit(False))
    marked = frames.withColumn("changed", changed)
    return marked.withColumn("scene_run", F.sum(F.col("changed").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def rolling_threshold(scores: DataFrame, keys: list[str], order: list[str], score: str = "score", window: int = 30, multiplier: float = 1.0, cold_std: float = 0.05) -> DataFrame:
    """``scores`` with rolling ``mean``, ``std`` (population; ``cold_std`` for a single score) and ``threshold``."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - window, 0)
    std = F.when(F.count(score).over(frame) < 2, F.lit(cold_std)).otherwise(F.stddev_pop(score).over(frame))
    out = scores.withColumn("mean", F.avg(score).over(frame)).withColumn("std", std)
    return out.withColumn("threshold", F.col("mean") - multiplier * F.col("std"))


def chunk_transcript(segments: DataFrame, chunk_sec: float = 30.0, overlap_sec: float = 5.0, key: str = "video_hash", pos: str = "pos") -> DataFrame:
    """Windows of ``chunk_sec`` every ``chunk_sec - overlap_sec`` with the segments that overlap them.

    A segment's windows follow from its times, so there is no range join: it is repeated for each and
    grouped. A chunk starts with its first segment, which may be before the window, and ends with its
    last, at the window's end at most. Empty windows are left out and chunks numbered without gaps.
    """
    step = chunk_sec - overlap_sec
    if step <= 0:
        raise ValueError("the overlap has to be shorter than the chunk")
    ends = segments.groupBy(key).agg(F.max("end").alias("_last"))
    timed = segments.join(ends, key)
    low = F.greatest(F.lit(0), F.floor((F.col("start") - chunk_sec) / step) + 1).cast("int")
    high = F.least(F.ceil(F.col("_last") / step) - 1, F.ceil(F.col("end") / step) - 1).cast("int")
    placed = timed.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high").withColumn("_window", F.explode(F.sequence("_low", "_high")))
    ordered = F.array_sort(F.collect_list(F.struct(pos, "start", "end", "text")))
    chunks = placed.groupBy(key, "_window").agg(ordered.alias("_s"))
    from ..functions.text import strip

    close = F.col("_window") * F.lit(float(step)) + chunk_sec
    number = F.row_number().over(Window.partitionBy(key).orderBy("_window")) - 1
    return chunks.select(
        key,
        number.alias("chunk_id"),
        F.round(F.element_at("_s", 1)["start"], 3).alias("start_time"),
        F.round(F.least(F.element_at("_s", -1)["end"], close), 3).alias("end_time"),
        strip(F.array_join(F.transform("_s", lambda s: strip(F.coalesce(s["text"], F.lit("")))), " ")).alias("text"),
    )
