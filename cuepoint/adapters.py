"""Models and decoders that callers supply, run in the tasks.

Each adapter takes a factory that makes the model once for each worker, and calls it on batches.
Deterministic stubs stand in for real models in tests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_made: dict[str, object] = {}
_tokens: dict[int, "Keyed"] = {}


class Keyed:
    """A factory under a token that the driver gave it; workers keep what it makes under the token."""

    def __init__(self, factory: Callable[[], object]):
        self.factory, self.token = factory, uuid.uuid4().hex


def keyed(factory: Callable[[], object] | Keyed) -> Keyed:
    """The factory's token: one for each factory object of this driver, so two lambdas of one function differ."""
    if isinstance(factory, Keyed):
        return factory
    if id(factory) not in _tokens:  # the entry holds the factory, so its id isn't given to another
        _tokens[id(factory)] = Keyed(factory)
    return _tokens[id(factory)]


def once(known: Keyed) -> object:
    """What the factory makes, kept for the life of the worker."""
    if known.token not in _made:
        _made[known.token] = known.factory()
    return _made[known.token]


def with_embeddings(rows: DataFrame, value: str, factory: Callable[[], Callable[[list], Iterable]], into: str = "embedding", batch: int = 64) -> DataFrame:
    """``rows`` with unit vectors of ``value`` (texts or pictures), embedded ``batch`` at a time."""
    known = keyed(factory)

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(known)
        for part in parts:
            out = []
            for a in range(0, len(part), batch):
                for v in model(list(part.iloc[a : a + batch])):
                    v = np.asarray(v, np.float64)
                    norm = float(np.linalg.norm(v))
                    out.append((v / norm if norm else v).astype(np.float32).tolist())
            yield pd.Series(out)

    return rows.withColumn(into, embed(F.col(value)))


def query_vectors(queries: DataFrame, text: str, frame_model: Callable, transcript_model: Callable, batch: int = 64) -> DataFrame:
    """``queries`` with a vector in the space of each index."""
    both = with_embeddings(queries, text, frame_model, "frame_vector", batch)
    return with_embeddings(both, text, transcript_model, "transcript_vector", batch)


class HashedWords:
    """A stub text embedder: words hashed into ``size`` signed bins."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


def transcribed(videos: DataFrame, factory: Callable[[], Callable[[str], Iterable[dict]]], key: str = "video_hash", path: str = "path") -> DataFrame:
    """Timed segments of every video: key, pos, id, start, end, text. The model gets a path."""
    kind, known = videos.schema[key].dataType.simpleString(), keyed(factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(known)
        for frame in frames:
            for video, where in zip(frame[key], frame[path], strict=True):
                rows = [{key: video, "pos": i, "id": int(s["id"]), "start": float(s["start"]), "end": float(s["end"]), "text": s["text"].strip()} for i, s in enumerate(model(where))]
                yield pd.DataFrame(rows, columns=[key, "pos", "id", "start", "end", "text"])

    return videos.select(key, path).mapInPandas(run, f"{key} {kind}, pos int, id int, start double, end double, text string")


def detected_scenes(videos: DataFrame, factory: Callable[[], Callable[[str], Iterable[tuple[float, float]]]], key: str = "video_hash", path: str = "path") -> DataFrame:
    """Raw scene cuts of every video, as the detector gives them."""
    kind, known = videos.schema[key].dataType.simpleString(), keyed(factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(known)
        for frame in frames:
            for video, where in zip(frame[key], frame[path], strict=True):
                yield pd.DataFrame([(video, float(a), float(b)) for a, b in model(where)], columns=[key, "start_sec", "end_sec"])

    return videos.select(key, path).mapInPandas(run, f"{key} {kind}, start_sec double, end_sec double")
