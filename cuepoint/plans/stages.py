"""Tables of a run's steps, so that a run that died goes on where it stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..shared import deleted

KEY = "video_hash"


class Stages:
    """Steps' rows by recording below ``folder``. A step is done for a recording once its rows are written and it
    is marked; what is marked isn't made again. Other settings have tables of their own; models are the caller's,
    who clears the stages after changing one."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings):
        self.spark = spark
        self.root = f"{folder.rstrip('/')}/_stages"
        self.folder = f"{self.root}/{hashlib.sha256(repr(settings).encode()).hexdigest()[:16]}"

    def _done(self, name: str) -> DataFrame:
        try:
            done = self.spark.read.schema(f"{KEY} string").parquet(f"{self.folder}/{name}_done")
            done.limit(0).count()
            return done.distinct()
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], f"{KEY} string")

    def step(self, name: str, videos: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows that ``make`` gives for ``videos``, made and written for those of them that lack the step."""
        path = f"{self.folder}/{name}"
        left = videos.join(self._done(name), KEY, "left_anti")
        rows = make(left)
        if not left.isEmpty():
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).parquet(path)
            left.select(F.col(KEY).cast("string")).write.mode("append").parquet(f"{self.folder}/{name}_done")
        elif self._done(name).isEmpty():
            return self.spark.createDataFrame([], rows.schema)
        return self.spark.read.schema(rows.schema).parquet(path).join(videos.select(KEY), KEY, "left_semi")

    def clear(self) -> None:
        """Delete all stages; for when what was made from them is in its place."""
        deleted(self.spark, self.root)
