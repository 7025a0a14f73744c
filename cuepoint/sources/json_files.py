"""JSON files: speech segments, annotations, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import schemas


def segments(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Segments (id, start, end, text) with their position in the file, and the ``key`` of the folder that it is in."""
    keys = [key] if key else []
    wrapped = spark.read.schema("value string" + "".join(f", {k} string" for k in keys)).option("wholetext", "true").text(path)
    rows = wrapped.select(*keys, F.posexplode(F.from_json("value", T.ArrayType(schemas.SEGMENT))).alias("pos", "s"))
    return rows.select(*keys, "pos", "s.*")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated queries, one a row, with the file's video and tolerance (30 s if it names none)."""
    whole = spark.read.schema(schemas.ANNOTATIONS).option("multiLine", "true").json(path)
    kept = ["video_hash", "video_name", "video_path", "annotated_at"]
    rows = whole.select(*kept, F.coalesce("timestamp_tolerance_sec", F.lit(30.0)).alias("tolerance"), F.posexplode("annotations").alias("pos", "a"))
    return rows.select(*kept, "tolerance", "pos", "a.*")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry from a JSON object keyed by video; empty if there is no file. A damaged file raises.

    Where a write was broken off between its two renames, the old registry is read.
    """
    for place in (path, path.rstrip("/") + "__old"):
        try:
            text = spark.read.option("wholetext", "true").text(place)
            break
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    else:
        return spark.createDataFrame([], schemas.REGISTRY)
    parsed = text.select(F.from_json("value", T.MapType(T.StringType(), schemas.REGISTRY), {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias("_key", "r")).select("r.*").withColumn("date_indexed", F.coalesce("date_indexed", F.lit("")))


def listing(rows: DataFrame) -> DataFrame:
    """Registered videos, the newest first."""
    return rows.orderBy(F.coalesce("date_indexed", F.lit("")).desc(), "video_hash")


def lookup(rows: DataFrame, video_hash: str) -> DataFrame:
    return rows.filter(F.col("video_hash") == video_hash)
