"""Row shapes of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BinaryType()

VIDEO = _schema(video_hash=_S, fps=_D, total_frames=_I, duration_sec=_D, width=_I, height=_I, path=_S)
FRAME = _schema(video_hash=_S, frame_idx=_I, timestamp=_D, frame=_B)
SCENE = _schema(video_hash=_S, scene_id=_I, start_sec=_D, end_sec=_D)
KEY_FRAME = _schema(video_hash=_S, frame_idx=_I, timestamp=_D, frame=_B, embedding=VECTOR)
SEGMENT = _schema(id=_I, start=_D, end=_D, text=_S)
CHUNK = _schema(video_hash=_S, chunk_id=_I, start_time=_D, end_time=_D, text=_S)
FRAME_INDEX = _schema(id=_S, video_hash=_S, frame_idx=_I, timestamp=_D, frame_path=_S, document=_S, embedding=VECTOR)
CHUNK_INDEX = _schema(id=_S, video_hash=_S, chunk_id=_I, start_time=_D, end_time=_D, document=_S, embedding=VECTOR)
REGISTRY = _schema(
    video_hash=_S, video_name=_S, video_path=_S, custom_name=_S, date_indexed=_S, total_keyframes=_I, total_chunks=_I, frames_dir=_S,
    transcript_path=_S, frames_collection=_S, transcript_collection=_S, ssim_reduction_pct=_D, clip_reduction_pct=_D, thumbnail_path=_S,
)
RESULT = _schema(query_id=_S, ord=_I, result_id=_S, video_hash=_S, timestamp=_D, score=_D, source=_S, text=_S, frame_path=_S)
ANNOTATIONS = _schema(
    video_hash=_S, video_name=_S, video_path=_S, annotated_at=_S, timestamp_tolerance_sec=_D, total_annotations=_I,
    annotations=T.ArrayType(_schema(query=_S, relevant_timestamps=T.ArrayType(_D), notes=_S)),
)
QUERY_METRIC = _schema(
    query=_S, retrieved_timestamps=T.ArrayType(_D), relevant_timestamps=T.ArrayType(_D), hits=T.ArrayType(T.BooleanType()),
    precision_at_k=_D, recall_at_k=_D, reciprocal_rank=_D, hit_at_k=T.BooleanType(),
)
REPORT = _schema(
    video_hash=_S, video_name=_S, k=_I, num_queries=_I, mean_precision_at_k=_D, mean_recall_at_k=_D, mrr=_D, hit_rate_at_k=_D,
    query_results=T.ArrayType(QUERY_METRIC),
)
ANSWER = _schema(
    query=_S, response_text=_S, timestamps=T.ArrayType(_D), keyframe_paths=T.ArrayType(_S), transcript_used=T.ArrayType(_S),
    sources=T.ArrayType(_schema(timestamp=_D, source=_S, score=_D, text=_S, frame_path=_S)), model_used=_S,
)
