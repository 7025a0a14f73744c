"""Indexing recordings: from files to the frame index, the transcript index and the registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..adapters import detected_scenes, transcribed, with_embeddings
from ..config import DEFAULT, Settings
from ..functions.text import chunk_id, frame_id
from ..operators import folds, registry, timeline
from ..shared import written
from ..sinks import tables
from ..sources import json_files
from ..sources.media import decoded_frames, video_files, video_metadata
from .stages import Stages


@dataclass(frozen=True)
class Models:
    """Factories of what reads and embeds media; each is called once for each worker."""

    probe: Callable
    decode: Callable
    scenes: Callable
    speech: Callable
    picture_vectors: Callable
    text_vectors: Callable
    #: Similarity of two decoded frames for the pixel filter.
    similarity: Callable = folds.ssim
    #: A raw picture and a quality to the bytes of a file; without it pictures are kept as they are decoded.
    encode: Callable | None = None
    #: Embeds questions in the space of the pictures.
    question_vectors: Callable | None = None


def frames_of(videos: DataFrame, models: Models, stages: Stages, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Kept frames with embeddings, and statistics of both filters for each video. ``frame`` holds the raw picture.

    Each frame is decoded once and each picture that the pixel filter keeps embedded once: both steps' rows are
    written, and pictures are kept only of frames that go on.
    """

    def pixel(new: DataFrame) -> DataFrame:
        scenes = timeline.tidy_scenes(cuts.join(new.select("video_hash"), "video_hash", "left_semi"), new, settings.min_scene_sec)
        frames = timeline.with_scenes(decoded_frames(new, models.decode, settings.sample_fps), scenes)
        filtered = folds.adaptive_filter(
            frames, ["video_hash"], ["timestamp", "frame_idx"], "frame", window=settings.window, multiplier=settings.std_multiplier, floor=settings.floor,
            ceiling=settings.ceiling, cold_mean=settings.cold_mean, cold_std=settings.cold_std, similarity=models.similarity, parts=settings.fold_parts,
        )
        return filtered.withColumn("frame", F.when(F.col("keep"), F.col("frame")))

    def embedded(new: DataFrame) -> DataFrame:
        kept = sampled.join(new.select("video_hash"), "video_hash", "left_semi").filter("keep").select("video_hash", "timestamp", "frame_idx", "frame")
        return with_embeddings(kept, "frame", models.picture_vectors, batch=settings.image_batch).drop("frame")

    cuts = stages.step("cuts", videos, lambda new: detected_scenes(new, models.scenes))
    sampled = stages.step("sampled", videos, pixel)
    vectors = stages.step("embedded", videos, embedded)
    semantic = folds.semantic_filter(vectors, ["video_hash"], ["timestamp", "frame_idx"], threshold=settings.semantic_threshold, parts=settings.fold_parts)
    key = ["video_hash"]
    stats = folds.filter_stats(sampled, key).select("video_hash", F.col("total_input").alias("n_sampled"), F.col("reduction_pct").alias("ssim_reduction_pct"))
    more = folds.filter_stats(semantic, key).select("video_hash", F.col("total_kept").cast("int").alias("total_keyframes"), F.col("reduction_pct").alias("clip_reduction_pct"))
    kept = semantic.filter("keep").drop("keep", "score").join(sampled.filter("keep").select("video_hash", "frame_idx", "frame"), ["video_hash", "frame_idx"])
    return kept, stats.join(more, key, "left")


def chunks_of(segments: DataFrame, models: Models, settings: Settings = DEFAULT) -> DataFrame:
    """Transcript windows of timed segments, with embeddings."""
    chunks = timeline.chunk_transcript(segments, settings.chunk_sec, settings.overlap_sec)
    return with_embeddings(chunks, "text", models.text_vectors, batch=settings.text_batch)


def index_videos(spark: SparkSession, videos: DataFrame, known: DataFrame, folder: str, models: Models, force: bool = False, settings: Settings = DEFAULT, stages: Stages | None = None) -> DataFrame:
    """Index the videos that aren't yet (all of them if forced) and return the registry, written.

    ``videos`` has video_hash, video_name and path. Index partitions of a video are replaced as a whole. Decoding,
    embedding and speech are stages of ``folder``: a run that died is taken up where it stopped. With ``stages`` of
    the caller, who clears them when the registry is in its place, they stay.
    """
    own = stages is None
    stages = stages or Stages(spark, folder, settings)
    pending = registry.pending(videos, known, force=force)
    new = stages.step("probed", pending, lambda left: video_metadata(left, models.probe))
    kept, stats = frames_of(new, models, stages, settings)
    coded = tables.encoded(kept, "frame", models.encode).drop("frame") if models.encode else kept.withColumnRenamed("frame", "jpeg")
    pictures = tables.keyframes(coded, f"{folder}/keyframes")
    frame_rows = pictures.select(frame_id(F.col("video_hash"), F.col("frame_idx")).alias("id"), "video_hash", "frame_idx", "timestamp", "frame_path", F.lit("").alias("document"), "embedding")
    tables.replace_videos(frame_rows, f"{folder}/frame_index", videos=new)
    # speech is recognised once; its file is what the windows are made from
    tables.segments_json(stages.step("spoken", new, lambda left: transcribed(left, models.speech)), f"{folder}/transcripts", "video_hash")
    spoken = chunks_of(new.select("video_hash").join(json_files.segments(spark, f"{folder}/transcripts", "video_hash"), "video_hash"), models, settings)
    chunk_rows = spoken.select(chunk_id(F.col("video_hash"), F.col("chunk_id")).alias("id"), "video_hash", F.col("chunk_id").cast("int").alias("chunk_id"), "start_time", "end_time", F.col("text").alias("document"), "embedding")
    tables.replace_videos(chunk_rows, f"{folder}/chunk_index", videos=new)

    indexed = spark.read.schema(schemas.FRAME_INDEX).parquet(f"{folder}/frame_index")
    first = indexed.groupBy("video_hash").agg(F.min_by("frame_path", "timestamp").alias("thumbnail_path"))
    counts = spark.read.schema(schemas.CHUNK_INDEX).parquet(f"{folder}/chunk_index").groupBy("video_hash").agg(F.count("*").cast("int").alias("total_chunks"))
    results = new.select("video_hash", "video_name", F.col("path").alias("video_path")).join(stats, "video_hash", "left").join(counts, "video_hash", "left").join(first, "video_hash", "left")
    rows = results.select(
        "video_hash", "video_name", "video_path", F.lit("").alias("custom_name"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("date_indexed"),
        F.coalesce("total_keyframes", F.lit(0)).alias("total_keyframes"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.concat_ws("/", F.lit("keyframes"), "video_hash").alias("frames_dir"),
        F.concat(F.lit("transcripts/video_hash="), "video_hash").alias("transcript_path"), F.concat("video_hash", F.lit("_frames")).alias("frames_collection"),
        F.concat("video_hash", F.lit("_transcript")).alias("transcript_collection"), F.coalesce("ssim_reduction_pct", F.lit(0.0)).alias("ssim_reduction_pct"),
        F.coalesce("clip_reduction_pct", F.lit(0.0)).alias("clip_reduction_pct"), F.coalesce("thumbnail_path", F.lit("")).alias("thumbnail_path"),
    )
    registered = written(registry.register(known, rows), "registry")
    if own:
        stages.clear()
    return registered


def index_path(spark: SparkSession, path: str, folder: str, models: Models, force: bool = False, settings: Settings = DEFAULT) -> DataFrame:
    """Index the video files at a path, those that aren't yet or all, and write the registry, which is returned as read back."""
    return index_files(spark, video_files(spark, path), folder, models, force, settings)


def index_files(spark: SparkSession, videos: DataFrame, folder: str, models: Models, force: bool = False, settings: Settings = DEFAULT) -> DataFrame:
    """As ``index_path``, for rows of ``video_files``."""
    where = f"{folder}/registry.json"
    known = json_files.registry(spark, where)
    if force or not registry.pending(videos, known).isEmpty():
        stages = Stages(spark, folder, settings)
        tables.registry_json(index_videos(spark, videos, known, folder, models, force, settings, stages), where)
        stages.clear()
    return json_files.registry(spark, where)


def search_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both indexes in the shape that searches take; an index that is missing is empty."""

    def opened(path: str, schema, columns: list) -> DataFrame:
        tables.ensure_table(spark, path, schema)
        return spark.read.schema(schema).parquet(path).select(*columns)

    frames = opened(f"{folder}/frame_index", schemas.FRAME_INDEX, ["id", "video_hash", "timestamp", "frame_path", "embedding"])
    chunks = opened(f"{folder}/chunk_index", schemas.CHUNK_INDEX, ["id", "video_hash", F.col("start_time").alias("timestamp"), F.col("document").alias("text"), "embedding"])
    return frames, chunks
