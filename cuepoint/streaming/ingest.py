"""Incremental ingest: new index rows by micro-batch, and both filters as stateful streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Settings
from ..operators.folds import Adaptive, dot
from ..plans import ingest
from ..plans.ingest import Models
from ..shared import written
from ..sinks.log import Log
from ..sinks.tables import upsert_rows
from ..sources import media


def upsert_stream(rows: DataFrame, path: str, schema, keys: list[str], checkpoint: str, partition: str = "video_hash"):
    """Keep an index table up to date from a stream of rows; a repeated batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_rows(batch.sparkSession, batch, path, schema, keys, partition)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def log_stream(rows: DataFrame, log: Log, checkpoint: str, name: str):
    """Commit a stream's rows to a log: each batch writes its own rows only, and a repeated one nothing."""

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            log.append(batch, stream=name, batch=number)

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def landing(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def index_stream(spark: SparkSession, path: str, folder: str, models: Models, checkpoint: str, settings: Settings = DEFAULT, per_batch: int = 1000):
    """Index recordings as they land at ``path``: from the file to both indexes and the registry.

    The stream's offsets say which files a batch holds, and the registry which of them are indexed, so a batch that is
    repeated after a failure indexes only what isn't in the registry yet, and takes its finished stages over. One
    recording that lands twice, in a batch or later, is indexed once. Files have to appear whole (``media.land``).
    """

    def index(batch: DataFrame, _: int) -> None:
        videos = batch.groupBy("video_hash").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "video_hash"]), "path").alias("v")).select("video_hash", "v.*")
        if not batch.isEmpty():
            ingest.index_files(batch.sparkSession, written(videos, "landed"), folder, models, settings=settings)

    return media.landing_files(spark, path, per_batch=per_batch).writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)


def semantic_stream(frames: DataFrame, key: str = "video_hash", order: str = "timestamp", vector: str = "embedding", threshold: float = 0.95, similarity: Callable = dot) -> DataFrame:
    """Kept frames of a stream. The state of a video is its last kept vector and the time of its last frame.

    Frames have to arrive in order of time across batches; within one they are sorted. A frame that is
    older than what its video has seen is left out, since its decision can't be taken any more.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, score double"

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for ts, v in zip(rows[order], rows[vector], strict=True):
            if seen is not None and ts < seen:
                continue
            seen = ts
            own = np.asarray(v, np.float64)
            score = None if last is None else similarity(np.asarray(last), own)
            if score is None or score < threshold:
                last = own.tolist()
                out.append((group[0], ts, score))
        state.update((last, seen))
        yield pd.DataFrame(out, columns=[key, order, "score"])

    state = f"last array<double>, seen {kinds[order]}"
    return frames.groupBy(key).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


def adaptive_stream(
    frames: DataFrame, key: str = "video_hash", order: str = "timestamp", value: str = "embedding", scene: str = "scene_id", window: int = 30, multiplier: float = 1.0,
    floor: float = 0.50, ceiling: float = 0.98, cold_mean: float = 0.85, cold_std: float = 0.05, similarity: Callable = dot,
) -> DataFrame:
    """The adaptive filter's decision on each frame of a stream: key, order, keep, score, threshold, reset.

    A video's state is four typed values: the last kept frame, the rolling scores, the scene and the time of the last
    frame. Frames have to arrive in order of time across batches; within one they are sorted, and what is older than its
    video's last frame is left out, since its decision can't be taken any more. A null key is a video too. Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    if kinds[value] not in ("binary", "array<float>", "array<double>"):
        raise ValueError(f"{value} is {kinds[value]}, not a picture or a vector")
    start = lambda: Adaptive(value, scene, window, multiplier, floor, ceiling, cold_mean, cold_std, similarity)
    rows = frames.select(key, order, value, scene)
    shape = f"{key} {kinds[key]}, {order} {kinds[order]}, keep boolean, score double, threshold double, reset boolean"
    processor = _AdaptiveProcessor(key, order, value, scene, kinds, start)
    return rows.groupBy(key).transformWithStateInPandas(processor, shape, "append", "none")


class _AdaptiveProcessor(StatefulProcessor):
    """Keeps the fold of each video between batches."""

    def __init__(self, key: str, order: str, value: str, scene: str, kinds: dict[str, str], start: Callable[[], Adaptive]):
        self.key, self.order, self.value, self.scene, self.kinds, self.start = key, order, value, scene, kinds, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", f"frame {self.kinds[self.value]}")
        self.scores = handle.getValueState("scores", "rolling array<double>")
        self.current = handle.getValueState("scene", f"scene {self.kinds[self.scene]}")
        self.seen = handle.getValueState("seen", f"at {self.kinds[self.order]}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold = self.start()
        seen = self.seen.get()[0] if self.seen.exists() else None
        if self.kept.exists():
            fold.resume(self._array(self.kept.get()[0]), list(self.scores.get()[0]), self.current.get()[0])
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        if seen is not None:
            batch = batch[batch[self.order] >= seen]
        if batch.empty:
            return
        scenes = [None if s is None or s != s else int(s) for s in batch[self.scene]]
        keep, score, threshold, reset = fold.decide([self._array(v) for v in batch[self.value]], scenes)
        last, scores, scene = fold.memory()
        self.kept.update((last.tobytes() if self.kinds[self.value] == "binary" else last.tolist(),))
        self.scores.update((scores,))
        self.current.update((scene,))
        self.seen.update((batch[self.order].iloc[-1].item(),))
        nullable = lambda x: pd.array(x, "Float64")
        yield pd.DataFrame({self.key: [key[0]] * len(batch), self.order: batch[self.order].to_numpy(), "keep": keep, "score": nullable(score), "threshold": nullable(threshold), "reset": pd.array(reset, "boolean")})

    def _array(self, value) -> np.ndarray:
        return np.asarray(value) if self.kinds[self.value] == "binary" else np.asarray(value, np.float32 if "float" in self.kinds[self.value] else np.float64)

    def close(self) -> None:
        pass
