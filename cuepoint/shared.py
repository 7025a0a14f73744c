"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: Folders made in each step that a thread is in.
_steps = threading.local()
#: Spark's setting that removes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or by an earlier ``setCheckpointDir``.

    Where neither is set, a single-process session gets a temporary folder of its own; on a cluster
    that's an error, as no folder is known to be shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if context.master.startswith("local[") or context.master == "local":
        folder = tempfile.mkdtemp(prefix="cuepoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        return context.getCheckpointDir().rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


_lock = threading.Lock()
_writers = 0


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any thread writes, and as it was when the last has ended: a query that ends before
    its stages do, as ``show`` may, would lose shuffles that are still written."""
    global _writers
    with _lock:
        _writers += 1
        if _writers == 1:
            _cleanup.before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.unset(_CLEANUP) if _cleanup.before is None else spark.conf.set(_CLEANUP, _cleanup.before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, known to ``release``."""
    folder = f"{shared_root(spark)}/cuepoint-{uuid.uuid4().hex}"
    _made.append(folder)
    for folders in getattr(_steps, "open", []):
        folders.append(folder)
    return f"{folder}/{name}"


def deleted(spark: SparkSession, folder: str) -> None:
    """Delete a folder on any store, if it's there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path):
        files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this driver; for when the results built on them are written."""
    while _made:
        deleted(spark, _made.pop())


def dropped(*frames: DataFrame) -> None:
    """Delete intermediate tables that what came of them, now written, no longer needs."""
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            deleted(frame.sparkSession, folder)


def written(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``frame`` to the shared folder and return it read back.

    The copy cuts the lineage, so a lost executor costs a read and not the work before it, and
    whatever is used twice is computed once. Shuffle files of the write go when it has ended.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    with _cleanup(spark):
        frame.write.parquet(path, compression=compression)
    return spark.read.schema(frame.schema).parquet(path)


def step(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the intermediate tables that this thread made on the way are deleted then."""
    made: list[str] = []
    _steps.open = [*getattr(_steps, "open", []), made]
    try:
        result = written(make(), name)
    finally:
        _steps.open = _steps.open[:-1]
    for folder in made[:-1]:  # the last is the result's
        deleted(spark, folder)
        if folder in _made:
            _made.remove(folder)
    return result
