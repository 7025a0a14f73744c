"""Settings that are part of what queries mean."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # sampling and scenes
    sample_fps: float = 1.0
    scene_threshold: float = 27.0
    min_scene_sec: float = 2.0
    # adaptive similarity filter; a larger multiplier lowers the threshold, so it drops more
    window: int = 30
    std_multiplier: float = 1.0
    floor: float = 0.50
    ceiling: float = 0.98
    cold_mean: float = 0.85
    cold_std: float = 0.05
    # semantic filter
    semantic_threshold: float = 0.95
    # tasks for both filters where single recordings are too long for one; 0: one task a recording
    fold_parts: int = 0
    # transcript windows
    chunk_sec: float = 30.0
    overlap_sec: float = 5.0
    # search
    initial_k: int = 10
    score_threshold: float = 0.27
    min_k: int = 2
    max_k: int = 10
    frame_weight: float = 0.4
    transcript_weight: float = 0.6
    dedup_sec: float = 30.0
    video_gate: float = 0.30
    top_videos: int = 3
    answer_gate: float = 0.20
    # re-ranking and answers
    rerank_skip: int = 2
    rerank_cap: int = 5
    clip_chars: int = 500
    parse_fallback: int = 3
    context_chars: int = 4000
    min_tail_chars: int = 50
    max_images: int = 5
    answer_tokens: int = 2048
    temperature: float = 0.2
    # evaluation
    tolerance_sec: float = 30.0
    eval_k: int = 5
    # batches
    image_batch: int = 32
    text_batch: int = 64
    # calls of language models: at a time in a task, attempts, and seconds before the second of them
    model_threads: int = 1
    model_tries: int = 1
    model_wait_sec: float = 1.0


DEFAULT = Settings()


def settings(spark=None, base: Settings = DEFAULT) -> Settings:
    """``base`` with what the environment (``CUEPOINT_MAX_K``) and, over it, the session (``spark.cuepoint.max_k``) set."""
    changed = {}
    for field in fields(base):
        value = os.environ.get(f"CUEPOINT_{field.name.upper()}")
        if spark is not None:
            value = spark.conf.get(f"spark.cuepoint.{field.name}", value)
        if value is not None:
            changed[field.name] = type(getattr(base, field.name))(value)
    return replace(base, **changed)
