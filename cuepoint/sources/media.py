"""Videos and pictures: metadata, frames, images. Decoding is the caller's; selection is the plan's."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import keyed, once
from ..functions.text import video_hash
from ..operators.timeline import duration, sample_frames, sample_step
from .frames import BATCH_FRAMES, RANGE_FRAMES, on_grid


def video_files(spark: SparkSession, path: str, pattern: str = "*.{mp4,mkv,avi,mov,webm}") -> DataFrame:
    """Video files by path with their key; contents are not read."""
    return _keyed_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def landing_files(spark: SparkSession, path: str, pattern: str = "*.{mp4,mkv,avi,mov,webm}", per_batch: int = 1000) -> DataFrame:
    """The rows of ``video_files`` as a stream: each file once, in batches of up to ``per_batch``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return _keyed_files(files.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path))


def _keyed_files(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(video_hash(name, F.col("length")).alias("video_hash"), name.alias("video_name"), "path", F.col("length").alias("size_bytes"))


def video_metadata(videos: DataFrame, factory: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """``videos`` with fps, total_frames, width and height from a prober, and the duration."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in videos.schema.fields)
    known = keyed(factory)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prober = once(known)
        for frame in frames:
            found = pd.DataFrame([prober(p) for p in frame["path"]], columns=["fps", "total_frames", "width", "height"], index=frame.index)
            yield pd.concat([frame, found], axis=1)

    probed = videos.mapInPandas(probe, f"{fields}, fps double, total_frames int, width int, height int")
    return probed.withColumn("duration_sec", duration(F.col("total_frames"), F.col("fps")))


def decoded_frames(videos: DataFrame, factory: Callable[[], Callable[[str, int, int, int], Iterable[tuple[int, bytes]]]], fps: float = 1.0, start_sec: float | None = None, end_sec: float | None = None) -> DataFrame:
    """Sampled frames with timestamps. A recording is cut into ranges of ``RANGE_FRAMES`` sampled frames, which are
    dealt to all tasks. The decoder gets a range's first and last frame and the step between wanted ones; what it
    gives besides those is left out before it crosses to the JVM."""
    known, spark = keyed(factory), videos.sparkSession
    step = sample_step(F.col("fps"), fps)
    first = (F.lit(start_sec or 0) * F.col("fps")).cast("int")
    last = F.col("total_frames") - 1 if end_sec is None else F.least(F.col("total_frames") - 1, (F.lit(end_sec) * F.col("fps")).cast("int"))
    wanted = videos.select("video_hash", "fps", "path", step.alias("step"), first.alias("first"), last.alias("last")).filter("first <= last")
    ranges = wanted.select("video_hash", "fps", "path", "step", F.explode(F.sequence("first", "last", F.col("step") * RANGE_FRAMES)).alias("first"), "last")
    ranges = ranges.withColumn("last", F.least("last", F.col("first") + F.col("step") * RANGE_FRAMES - 1))
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_hash", "first")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, names = once(known), ["video_hash", "fps", "frame_idx", "frame"]
        for frame in frames:
            for row in frame.itertuples():
                part: list[tuple] = []
                for index, picture in on_grid(decoder, row.path, row.first, row.last, row.step):
                    part.append((row.video_hash, float(row.fps), index, picture))
                    if len(part) == BATCH_FRAMES:
                        yield pd.DataFrame(part, columns=names)
                        part = []
                yield pd.DataFrame(part, columns=names)

    raw = dealt.mapInPandas(decode, "video_hash string, fps double, frame_idx int, frame binary")
    return sample_frames(raw, F.col("fps"), fps, start_sec, end_sec).drop("fps")


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of a keyframe table: frame_path, relative as in the index, and image."""
    return spark.read.parquet(folder).select("frame_path", F.col("content").alias("image"))


def picture_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of a folder of files: frame_path, relative to the folder, and image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split("://")[-1] + "/"
    return files.select(F.substring("path", F.instr("path", root) + len(root), F.length("path")).alias("frame_path"), F.col("content").alias("image"))


def images(paths: DataFrame, known: DataFrame, column: str = "frame_path", resize: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """``paths`` with the ``image`` of each, by its whole path; null where there is none. ``known``: frame_path, image."""
    found = known.select(F.col("frame_path").alias("_path"), "image")
    joined = paths.join(found, F.col(column) == F.col("_path"), "left").drop("_path")
    if resize is None:
        return joined
    fit = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else resize(x)), "binary")
    return joined.withColumn("image", fit("image"))


def land(spark: SparkSession, path: str, folder: str) -> str:
    """Copy an uploaded file into the folder unless it is there already, and return its place there.

    It is copied under a hidden name and then renamed, so a stream on the folder never sees a part of it.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, conf = hadoop.Path(path), spark._jsc.hadoopConfiguration()
    target = hadoop.Path(f"{folder.rstrip('/')}/{source.getName()}")
    files = target.getFileSystem(conf)
    if not files.exists(target):
        aside = hadoop.Path(f"{folder.rstrip('/')}/.{source.getName()}.{uuid.uuid4().hex}")
        hadoop.FileUtil.copy(source.getFileSystem(conf), source, files, aside, False, False, conf)
        if not files.rename(aside, target):
            files.delete(aside, False)
            if not files.exists(target):
                raise OSError(f"{target} can't be put in its place")
    return target.toString()
