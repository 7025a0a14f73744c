"""Folds: operators whose state depends on what they decided before.

Rows are dealt by key and sorted, and a task goes through them batch by batch with one key's state in
hand, so memory doesn't grow with a key's rows. Keys run in parallel; within a key the order is part of
the meaning.
"""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of pictures that are compared or turned gray at once; working arrays are some fifty times that.
STACK_BYTES = 1 << 20


def sorted_fold(frame: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], added: str) -> DataFrame:
    """``frame`` with the columns ``added`` ("name type, ...") that each key's fold gives its rows.

    ``start()`` makes a key's state; its ``step(batch)`` gets the key's rows in order, in pieces, and
    returns an array for each added column. Null is a key, and so is NaN.
    """
    names = [part.split()[0] for part in added.split(", ")]
    kept = [c for c in frame.columns if c not in names]
    rows = frame.select(*kept).repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = [kept.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = list(zip(*(["nan" if v != v else v for v in batch.column(i).to_pylist()] for i in at), strict=True))
            cuts = [0] + [i for i in range(1, len(values)) if values[i] != values[i - 1]] + [len(values)]
            parts: list[list] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if state is None or values[a] != key:
                    key, state = values[a], start()
                parts.append(state.step(batch.slice(a, b - a)))
            new = [pa.concat_arrays([pa.array(p[i]) if not isinstance(p[i], pa.Array) else p[i] for p in parts]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *names])

    return rows.mapInArrow(run, f"{fields}, {added}")


class _Anchored:
    """Groups of rows within ``window`` of the group's first row; groups don't chain."""

    def __init__(self, ts: str, window: float):
        self.ts, self.window, self.anchor, self.group = ts, window, None, -1

    def step(self, batch: pa.RecordBatch) -> list:
        ts = batch.column(self.ts).to_numpy(zero_copy_only=False).astype(float)
        groups, anchors = np.empty(len(ts), np.int64), np.empty(len(ts))
        i = 0
        while i < len(ts):
            if self.anchor is None or ts[i] - self.anchor > self.window:
                self.anchor, self.group = ts[i], self.group + 1
            j = i + int(np.searchsorted(ts[i:] - self.anchor, self.window, "right"))
            groups[i:j], anchors[i:j] = self.group, self.anchor
            i = max(j, i + 1)
        return [groups, anchors]


def anchored_groups(frame: DataFrame, keys: list[str], ts: str, order: list[str], window: float = 30.0) -> DataFrame:
    """``frame`` with ``grp`` (from 0 in each key) and ``anchor``: rows up to ``window`` behind a group's first."""
    return sorted_fold(frame, keys, [ts, *order], lambda: _Anchored(ts, window), "grp bigint, anchor double")


def best_of_groups(grouped: DataFrame, keys: list[str], score: Column, ts: str, order: list[str]) -> DataFrame:
    """The row with the highest score of each group; the earliest of equal ones."""
    window = Window.partitionBy(*keys, "grp").orderBy(score.desc(), ts, *order)
    return grouped.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")


def anchored_best(results: DataFrame, keys: list[str], window: float) -> DataFrame:
    """W5 for short result lists (columns timestamp, score, ord): folded as one array a key, in the JVM."""
    columns = [c for c in results.columns if c not in keys]
    row = F.struct("timestamp", "ord", *[c for c in columns if c not in ("timestamp", "ord")])
    lists = results.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    seed = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        new = s["anchor"].isNull() | (x["timestamp"] - s["anchor"] > window)
        g = F.when(new, s["g"] + 1).otherwise(s["g"])
        return F.struct(F.when(new, x["timestamp"]).otherwise(s["anchor"]).alias("anchor"), g.alias("g"), F.concat(s["all"], F.array(g)).alias("all"))

    folded = lists.withColumn("_groups", F.aggregate("_rows", seed, step)["all"])
    flat = folded.select(*keys, F.explode(F.arrays_zip("_rows", "_groups")).alias("_x")).select(*keys, "_x._rows.*", F.col("_x._groups").alias("grp"))
    return best_of_groups(flat, keys, F.col("score"), "timestamp", ["ord"])


def dot(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a.astype(np.float64), b.astype(np.float64)))


def _luma(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image."""
    return image.astype(np.float64) if image.ndim == 2 else _luma(image)


def rgb(image: np.ndarray) -> np.ndarray:
    """A BGR image with its channels in the order that embedders expect."""
    return image[..., ::-1]


def _stacks(pictures: pa.Array, *shape: int) -> Iterator[np.ndarray]:
    """Pictures of one shape, none null, as arrays of several that have ``STACK_BYTES`` at most, or one."""
    size = math.prod(shape)
    plain = pictures.cast(pa.binary(size))  # raises where a picture has another size
    data = np.frombuffer(plain.buffers()[1], np.uint8, len(plain) * size, plain.offset * size).reshape(-1, *shape)
    step = max(1, STACK_BYTES // size)
    for at in range(0, len(data), step):
        yield data[at : at + step]


def _spread(values: pa.Array, known: np.ndarray) -> pa.Array:
    """``values`` at the places that are known, null at the others."""
    return values.take(pa.array(np.cumsum(known) - 1, pa.int64(), mask=~known))


def gray_frames(frames: DataFrame, column: str, height: int, width: int, into: str = "gray") -> DataFrame:
    """``frames`` with the luma of raw BGR pictures (binary, row by row), a byte a pixel; null where there is none."""

    @F.arrow_udf("binary")
    def convert(pictures: pa.Array) -> pa.Array:
        known = pictures.is_valid().to_numpy(zero_copy_only=False)
        shades = [_luma(x).astype(np.uint8).tobytes() for x in _stacks(pictures.drop_null(), height, width, 3)] if known.any() else []
        values = pa.Array.from_buffers(pa.binary(height * width), int(known.sum()), [None, pa.py_buffer(b"".join(shades))])
        return _spread(values.cast(pa.binary()), known)

    return frames.withColumn(into, convert(F.col(column)))


def _structure(a: np.ndarray, b: np.ndarray, side: int, span: float) -> np.ndarray:
    """Mean structural similarity (Wang et al. 2004) of gray images, or of two stacks of them, with square windows."""
    side = min(side, *a.shape[-2:])
    n = side * side

    def mean(x: np.ndarray) -> np.ndarray:
        total = np.zeros((*x.shape[:-2], x.shape[-2] + 1, x.shape[-1] + 1))
        total[..., 1:, 1:] = x.cumsum(-2).cumsum(-1)
        return (total[..., side:, side:] - total[..., :-side, side:] - total[..., side:, :-side] + total[..., :-side, :-side]) / n

    mu, nu = mean(a), mean(b)
    unbiased = n / max(n - 1, 1)
    va, vb, cov = (unbiased * (mean(x) - y) for x, y in ((a * a, mu * mu), (b * b, nu * nu), (a * b, mu * nu)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return (((2 * mu * nu + c1) * (2 * cov + c2)) / ((mu * mu + nu * nu + c1) * (va + vb + c2))).mean((-2, -1))


def ssim(a: np.ndarray, b: np.ndarray, side: int = 7, span: float = 255.0) -> float:
    """Mean structural similarity of two images; may be negative."""
    return float(_structure(gray(a), gray(b), side, span))


def frame_similarity(pairs: DataFrame, a: str, b: str, height: int, width: int, into: str = "ssim", side: int = 7) -> DataFrame:
    """``pairs`` with the structural similarity of two gray frames (binary, row by row); null where one is."""

    @F.arrow_udf("double")
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        both = pc.and_(x.is_valid(), y.is_valid())
        known = both.to_numpy(zero_copy_only=False)
        stacks = zip(_stacks(x.filter(both), height, width), _stacks(y.filter(both), height, width), strict=True) if known.any() else []
        found = [_structure(u.astype(np.float64), v.astype(np.float64), side, 255.0) for u, v in stacks]
        return _spread(pa.array(np.concatenate([np.zeros(0), *found])), known)

    return pairs.withColumn(into, compare(F.col(a), F.col(b)))


def _packed(value: np.ndarray | None) -> tuple | None:
    return None if value is None else (value.dtype.str, value.shape, value.tobytes())


def _opened(packed: tuple | None) -> np.ndarray | None:
    return None if packed is None else np.frombuffer(packed[2], packed[0]).reshape(packed[1])


class _Semantic:
    """Drops a row as similar as ``threshold`` to the last one kept."""

    def __init__(self, vector: str, threshold: float, similarity: Callable):
        self.vector, self.threshold, self.similarity, self.last = vector, threshold, similarity, None

    def save(self) -> bytes:
        return pickle.dumps(_packed(self.last))

    def load(self, saved: bytes) -> None:
        self.last = _opened(pickle.loads(saved))

    def step(self, batch: pa.RecordBatch) -> list:
        keep, scores = [], []
        for value in batch.column(self.vector):
            own = np.asarray(value.values if hasattr(value, "values") else value.as_py())
            score = None if self.last is None else self.similarity(self.last, own)
            keep.append(score is None or score < self.threshold)
            scores.append(score)
            if keep[-1]:
                self.last = own
        return [pa.array(keep, pa.bool_()), pa.array(scores, pa.float64())]


def semantic_filter(frames: DataFrame, keys: list[str], order: list[str], vector: str = "embedding", threshold: float = 0.95, similarity: Callable = dot, parts: int = 0) -> DataFrame:
    """``frames`` with ``keep`` and ``score`` (similarity to the last kept frame; null for the first).

    With ``parts`` long recordings are cut and folded by that many tasks, with the same result (``speculative_fold``).
    """
    return _folded(frames, keys, order, lambda: _Semantic(vector, threshold, similarity), "keep boolean, score double", [vector], parts)


def _folded(frames: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], added: str, reads: list[str], parts: int) -> DataFrame:
    from .speculative import speculative_fold

    return speculative_fold(frames, keys, order, start, added, reads, parts) if parts else sorted_fold(frames, keys, order, start, added)


class Adaptive:
    """Drops a row that is more similar to the last kept one than a rolling threshold.

    The score joins the window before the threshold is taken; a change of scene empties the window and
    leaves the last kept frame as it is, so only the very first frame is kept without a score.
    """

    def __init__(self, value: str, scene: str, window: int, multiplier: float, floor: float, ceiling: float, cold_mean: float, cold_std: float, similarity: Callable):
        self.value, self.scene, self.multiplier, self.floor, self.ceiling = value, scene, multiplier, floor, ceiling
        self.cold_mean, self.cold_std, self.similarity = cold_mean, cold_std, similarity
        self.window: deque[float] = deque(maxlen=window)
        self.last, self.current, self.begun = None, None, False

    def save(self) -> bytes:
        last, scores, scene = self.memory()
        return pickle.dumps((_packed(last), scores, scene, self.begun))

    def load(self, saved: bytes) -> None:
        last, scores, scene, begun = pickle.loads(saved)
        if begun:
            self.resume(_opened(last), scores, scene)

    def _threshold(self) -> float:
        scores = np.array(self.window)
        mean = scores.mean() if len(scores) else self.cold_mean
        std = scores.std() if len(scores) > 1 else self.cold_std
        return float(mean - self.multiplier * std)

    def resume(self, last: np.ndarray | None, scores: list[float], scene: int | None) -> None:
        """Go on behind a frame: the last kept one, the scores in the window and the scene that it left."""
        self.last, self.current, self.begun = last, scene, True
        self.window.clear()
        self.window.extend(scores)

    def memory(self) -> tuple[np.ndarray | None, list[float], int | None]:
        return self.last, [float(s) for s in self.window], self.current

    def decide(self, values: list[np.ndarray], scenes: list) -> tuple[list, list, list, list]:
        """Lists of keep, score, threshold and reset for frames that follow."""
        keeps, scores, thresholds, resets = [], [], [], []
        for own, scene in zip(values, scenes, strict=True):
            reset = self.begun and scene != self.current
            if reset:
                self.window.clear()
            self.current = scene
            score = threshold = None
            keep = True
            if self.begun:
                score = self.similarity(self.last, own)
                self.window.append(score)
                threshold = self._threshold()
                keep = score < self.floor or (score <= self.ceiling and score <= threshold)
            if keep:
                self.last = own
            self.begun = True
            for column, x in zip((keeps, scores, thresholds, resets), (keep, score, threshold, reset), strict=True):
                column.append(x)
        return keeps, scores, thresholds, resets

    def step(self, batch: pa.RecordBatch) -> list:
        values = [np.asarray(v.values if hasattr(v, "values") else v.as_py()) for v in batch.column(self.value)]
        keeps, scores, thresholds, resets = self.decide(values, batch.column(self.scene).to_pylist())
        return [pa.array(keeps, pa.bool_()), pa.array(scores, pa.float64()), pa.array(thresholds, pa.float64()), pa.array(resets, pa.bool_())]


def adaptive_filter(
    frames: DataFrame, keys: list[str], order: list[str], value: str, scene: str = "scene_id", window: int = 30, multiplier: float = 1.0,
    floor: float = 0.50, ceiling: float = 0.98, cold_mean: float = 0.85, cold_std: float = 0.05, similarity: Callable = dot, parts: int = 0,
) -> DataFrame:
    """``frames`` with ``keep``, ``score``, ``threshold`` and ``reset``; ``scene`` is -1 outside of all scenes. ``parts`` as in ``semantic_filter``."""
    start = lambda: Adaptive(value, scene, window, multiplier, floor, ceiling, cold_mean, cold_std, similarity)
    return _folded(frames, keys, order, start, "keep boolean, score double, threshold double, reset boolean", [value, scene], parts)


def filter_stats(filtered: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, reduction in percent and the scores' mean and population deviation; zeros where there is nothing."""
    from ..functions.text import reduction_pct

    grouped = filtered.groupBy(*keys) if keys else filtered.groupBy()
    stats = grouped.agg(F.count("*").alias("total_input"), F.count_if("keep").alias("total_kept"), F.avg("score").alias("_mean"), F.stddev_pop("score").alias("_std"))
    dropped = F.col("total_input") - F.col("total_kept")
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4)
    return stats.select(*keys, "total_input", "total_kept", dropped.alias("total_dropped"), reduction_pct(dropped, F.col("total_input")).alias("reduction_pct"), zero("_mean").alias("mean_score"), zero("_std").alias("std_score"))


def score_lists(filtered: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each key the ordered lists of ``columns`` (scores, thresholds), without the rows that have none."""
    rows = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(*order, c)))), lambda x: x[c])
    return filtered.groupBy(*keys).agg(*[rows(c).alias(f"{c}s") for c in columns])
