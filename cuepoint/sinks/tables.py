"""Writers: index tables, pictures, JSON files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frame_file, strip
from ..operators.registry import upsert


def ensure_table(spark: SparkSession, path: str, schema, partition: str = "video_hash") -> None:
    """An empty table at ``path`` if there is none."""
    try:
        spark.read.schema(schema).parquet(path).limit(0).count()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        spark.createDataFrame([], schema).write.partitionBy(partition).parquet(path)


def replace_videos(rows: DataFrame, path: str, partition: str = "video_hash", videos: DataFrame | None = None) -> None:
    """Write the index rows of some videos in place of all that these had, and leave other videos alone.

    Ids that a new run doesn't make any more go with the old partition; so does the partition of a video
    of ``videos``, the run's input, that has no rows at all.
    """
    rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    if videos is not None:
        spark = rows.sparkSession
        none = videos.select(partition).distinct().join(rows.select(partition).distinct(), partition, "left_anti")
        _drop(spark, (f"{path.rstrip('/')}/{partition}={r[0]}" for r in none.toLocalIterator()))


def _drop(spark: SparkSession, folders) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in folders:
        folder = hadoop(name)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(folder):
            files.delete(folder, True)


def _swap(spark: SparkSession, aside: str, path: str) -> None:
    """Put a finished folder in the place of another; until it's there the old one stays beside it as ``__old``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, place, old = hadoop(aside), hadoop(path), hadoop(path.rstrip("/") + "__old")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place):
        if files.exists(old):
            files.delete(old, True)
        files.rename(place, old)
    files.rename(new, place)
    if files.exists(old):
        files.delete(old, True)


def upsert_rows(spark: SparkSession, rows: DataFrame, path: str, schema, keys: list[str], partition: str = "video_hash") -> None:
    """Keyed upsert: the partitions that ``rows`` touch are merged, last write first, and replaced.

    The merged rows are written aside first, to a folder of this call's own, as a partition can't be
    read and replaced in one go.
    """
    ensure_table(spark, path, schema, partition)
    touched = rows.select(partition).distinct()
    current = spark.read.schema(schema).parquet(path).join(touched, partition, "left_semi")
    aside = f"{path.rstrip('/')}__merge_{uuid.uuid4().hex}"
    upsert(current, rows, keys).write.parquet(aside)
    replace_videos(spark.read.parquet(aside), path, partition)
    _drop(spark, [aside])


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """The collections of an index by name and their sizes."""
    return sizes(*(spark.read.parquet(f"{folder}/{name}") for name in ("frame_index", "chunk_index")))


def sizes(frames: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, video_hash, kind (frames or transcript) and rows of each video's part of both indexes."""
    count = lambda rows, kind: rows.groupBy("video_hash").agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind))
    both = count(frames, "frames").unionByName(count(chunks, "transcript"))
    return both.select(F.concat_ws("_", "video_hash", "kind").alias("name"), "video_hash", "kind", "rows")


def delete_videos(spark: SparkSession, hashes: list[str], paths: list[str], registry_rows: DataFrame) -> DataFrame:
    """Drop the partitions of some videos from the index tables and return the registry without them."""
    _drop(spark, (f"{path.rstrip('/')}/video_hash={h}" for path in paths for h in hashes))
    return registry_rows.filter(~F.col("video_hash").isin(hashes))


def encoded(frames: DataFrame, column: str, encode: Callable[[bytes, int], bytes], quality: int = 95, into: str = "jpeg") -> DataFrame:
    """``frames`` with their pictures as files' bytes: ``encode`` gets a raw picture and the quality, in the tasks."""
    write = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else encode(x, quality)), "binary")
    return frames.withColumn(into, write(F.col(column)))


def saved_frames(frames: DataFrame, path: str, encode: Callable[[bytes, int], bytes] | None = None, quality: int = 95) -> None:
    """Write pictures (frame_path, frame) as rows of a table, encoded if asked for; any table of frames, not only key frames."""
    rows = encoded(frames, "frame", encode, quality, "content") if encode else frames.withColumnRenamed("frame", "content")
    rows.select("frame_path", "content").write.mode("append").parquet(path)


def keyframes(frames: DataFrame, folder: str) -> DataFrame:
    """Write pictures (video_hash, frame_idx, timestamp, jpeg) below ``folder`` and return their relative paths.

    Pictures are rows of a table keyed by path, which every executor can write to any store.
    """
    named = frames.withColumn("frame_path", F.concat_ws("/", F.lit("keyframes"), "video_hash", frame_file(F.col("frame_idx"), F.col("timestamp"))))
    named.select("video_hash", "frame_path", F.col("jpeg").alias("content")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_hash").parquet(folder)
    return named.drop("jpeg")


def segments_json(segments: DataFrame, path: str, key: str | None = None) -> None:
    """Segments as JSON arrays in the order of ``pos``: one for the path or, by ``key``, one in each of its folders."""
    entry = F.struct("id", "start", "end", strip(F.col("text")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("s")))), lambda x: x["s"])
    whole = (segments.groupBy(key) if key else segments.groupBy()).agg(F.to_json(ordered).alias("value"))
    writer = whole.write.mode("overwrite")
    if key:
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)
    else:
        writer.text(path)


def one_json(rows: DataFrame, path: str) -> None:
    """A single JSON object of a one-row frame, such as a report or an annotation file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def swapped_json(rows: DataFrame, path: str) -> None:
    """``one_json`` for rows that may come from the file that they replace."""
    aside = f"{path.rstrip('/')}__new_{uuid.uuid4().hex}"
    one_json(rows, aside)
    _swap(rows.sparkSession, aside, path)


def registry_json(rows: DataFrame, path: str) -> None:
    """The registry as one object keyed by video. It's written aside and then put in the old one's place, so rows
    may come from the file that they replace."""
    columns = F.struct(*rows.columns)
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("video_hash", columns)))).alias("value"))
    aside = f"{path.rstrip('/')}__new_{uuid.uuid4().hex}"
    whole.coalesce(1).write.text(aside)
    _swap(rows.sparkSession, aside, path)


def merged_annotations(existing: DataFrame, new: DataFrame, annotated_at: str | None = None) -> DataFrame:
    """Old annotations and new ones, with the count taken anew, as the one row of each video's annotation file.

    The file is dated ``annotated_at``, or else as the rows are.
    """
    rows = existing.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    for column in ("video_path", "annotated_at"):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast("string"))
    entries = F.array_sort(F.collect_list(F.struct("_late", "pos", F.struct("query", "relevant_timestamps", "notes").alias("a"))))
    return rows.groupBy("video_hash").agg(
        F.max("video_name").alias("video_name"), F.max("video_path").alias("video_path"),
        (F.lit(annotated_at) if annotated_at else F.max("annotated_at")).alias("annotated_at"),
        F.max("tolerance").alias("timestamp_tolerance_sec"), F.count("*").cast("int").alias("total_annotations"),
        F.transform(entries, lambda e: e["a"]).alias("annotations"),
    )
