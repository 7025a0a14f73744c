"""Frames of recordings as a Spark data source: filters on recording, frame and time reach the decoder.

``frame_table`` gives the sampled frames of probed recordings (video_hash, path, fps, total_frames). What is planned is ranges of frames, not files: one long recording is read by many tasks, short
ones share a task, and what a filter rules out is never decoded.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..adapters import Keyed, keyed, once

Decoder = Callable[[str, int, int, int], Iterable[tuple[int, bytes]]]
SCHEMA = "video_hash string, frame_idx int, timestamp double, frame binary"

#: Sampled frames that a task decodes in one go.
RANGE_FRAMES = 600
#: Frames of an Arrow batch.
BATCH_FRAMES = 64


def on_grid(decoder: Decoder, path: str, first: int, last: int, step: int) -> Iterator[tuple[int, bytes]]:
    """The wanted frames of a range; a decoder may give others too."""
    return ((int(i), picture) for i, picture in decoder(path, first, last, step) if first <= i <= last and not (i - first) % step)


def seconds(index: int, fps: float) -> float:
    """A frame's time in milliseconds' precision, halves up, as Spark's ``round`` has it."""
    return float(Decimal(repr(index / fps)).quantize(Decimal("0.001"), ROUND_HALF_UP))


@dataclass
class Bounds:
    """What pushed filters leave: recordings (None: all) and inclusive limits of frame numbers and times."""

    videos: set[str] | None = None
    low: float = -math.inf
    high: float = math.inf
    begin: float = -math.inf
    end: float = math.inf

    def narrow(self, condition: Filter) -> None:
        """Take a condition into account, or leave the bounds wider than it; Spark tests every row again."""
        column = getattr(condition, "attribute", None)
        if column == ("video_hash",) and isinstance(condition, EqualTo | In):
            named = set(condition.value) if isinstance(condition, In) else {condition.value}
            self.videos = named if self.videos is None else self.videos & named
        elif column in (("frame_idx",), ("timestamp",)) and isinstance(condition, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            below, above = ("low", "high") if column == ("frame_idx",) else ("begin", "end")
            past = 1 if column == ("frame_idx",) else 0  # a strict limit of whole numbers is the next one's
            if isinstance(condition, EqualTo | GreaterThan | GreaterThanOrEqual):
                setattr(self, below, max(getattr(self, below), condition.value + (past if isinstance(condition, GreaterThan) else 0)))
            if isinstance(condition, EqualTo | LessThan | LessThanOrEqual):
                setattr(self, above, min(getattr(self, above), condition.value - (past if isinstance(condition, LessThan) else 0)))

    def frames(self, first: int, last: int, step: int, fps: float) -> tuple[int, int]:
        """First and last frame of a grid within the bounds. Times are rounded, so their limits are a millisecond wider."""
        low, high = max(first, self.low, (self.begin - 0.001) * fps), min(last, self.high, (self.end + 0.001) * fps)
        if low > high:
            return 0, -1
        return first + math.ceil((low - first) / step) * step, math.floor(high)


@dataclass
class Ranges(InputPartition):
    """What a task decodes: (video_hash, path, fps, first frame, last frame, step) of each range."""

    parts: list[tuple[str, str, float, int, int, int]]


class VideoFrames(DataSource):
    """The format behind ``frame_table``, which binds a decoder to it."""

    decoder: Keyed
    recordings: pa.Table

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options, self.decoder, self.recordings)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict, decoder: Keyed, recordings: pa.Table | None):
        self.recordings, self.decoder, self.bounds = recordings, decoder, Bounds()
        self.fps, self.tasks = float(options.get("fps", 1.0)), int(options.get("tasks", 10_000))
        self.start, self.end = float(options.get("start", 0.0)), float(options.get("end", math.inf))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            self.bounds.narrow(condition)
        return filters

    def __getstate__(self) -> dict:
        return self.__dict__ | {"recordings": None}  # tasks get their ranges

    def partitions(self) -> list[Ranges]:
        wanted = []
        for video, path, fps, total in zip(*(c.to_pylist() for c in self.recordings.columns), strict=True):
            if self.bounds.videos is not None and video not in self.bounds.videos:
                continue
            step = max(1, round(fps / self.fps))
            last = total - 1 if self.end == math.inf else min(total - 1, int(self.end * fps))
            while last >= 0 and last / fps > self.end:
                last -= 1
            first, last = self.bounds.frames(math.floor(self.start * fps), last, step, fps)
            if first <= last:
                wanted.append((video, path, float(fps), first, last, step))
        frames = sum((last - first) // step + 1 for *_, first, last, step in wanted)
        share = max(RANGE_FRAMES, -(-frames // self.tasks))
        out: list[Ranges] = []
        room = 0
        for video, path, fps, first, last, step in wanted:
            while first <= last:
                if not room:
                    out.append(Ranges([]))
                    room = share
                count = min(room, (last - first) // step + 1)
                out[-1].parts.append((video, path, fps, first, first + (count - 1) * step, step))
                first, room = first + count * step, room - count
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("video_hash", pa.string()), ("frame_idx", pa.int32()), ("timestamp", pa.float64()), ("frame", pa.binary())])
        for video, path, fps, first, last, step in partition.parts:
            part: list[tuple[int, bytes]] = []
            for found in on_grid(once(self.decoder), path, first, last, step):
                part.append(found)
                if len(part) == BATCH_FRAMES:
                    yield self._batch(part, video, fps, schema)
                    part = []
            if part:
                yield self._batch(part, video, fps, schema)

    def _batch(self, part: list[tuple[int, bytes]], video: str, fps: float, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"video_hash": [video] * len(part), "frame_idx": [i for i, _ in part], "timestamp": [seconds(i, fps) for i, _ in part], "frame": [p for _, p in part]}, schema)


def frame_table(videos: DataFrame, factory: Callable[[], Decoder], fps: float = 1.0, start_sec: float | None = None, end_sec: float | None = None, tasks: int = 10_000) -> DataFrame:
    """Sampled frames (video_hash, frame_idx, timestamp, frame) of ``videos``, each of which is read.

    ``start_sec`` and ``end_sec`` say where the sampling grid begins and ends, as in ``decoded_frames``; filters on
    video_hash, frame_idx and timestamp only choose among its frames, and reach the reader. A task takes at least
    ``RANGE_FRAMES`` frames, and more where there would be over ``tasks`` tasks.

    The driver plans, so it holds four values of each recording, from when this is called, and an entry for each range;
    nothing of a recording's contents. Recordings without a path, frames or a positive rate have no frames; those
    without a key keep a null one. Turns on the session's setting that lets filters reach Python sources.
    """
    spark, known = videos.sparkSession, keyed(factory)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    usable = videos.filter("path IS NOT NULL AND fps > 0 AND NOT isnan(fps) AND total_frames > 0")
    recordings = usable.selectExpr("cast(video_hash AS string)", "path", "cast(fps AS double)", "cast(total_frames AS int)").toArrow()
    name = f"frames_{uuid.uuid4().hex}"
    spark.dataSource.register(type("BoundFrames", (VideoFrames,), {"decoder": known, "recordings": recordings, "name": classmethod(lambda cls: name)}))
    reader = spark.read.format(name).option("fps", fps).option("tasks", tasks)
    for option, value in (("start", start_sec), ("end", end_sec)):
        reader = reader if value is None else reader.option(option, value)
    return reader.load()
