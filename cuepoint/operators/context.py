"""Context, prompts, re-ranking and answers around a language model that callers supply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.replies import selected
from ..functions.text import clipped, context_line, minutes_clock, strip
from .calls import replies

NOTHING_FOUND = "No part of the recording seems to answer this question. Another wording may help."


def budgeted_context(rows: DataFrame, keys: list[str], budget: int = 4000, least_tail: int = 50, ts: str = "timestamp", text: str = "text", pos: str = "ord") -> DataFrame:
    """``context`` for each key: lines in order of time while their lengths fit the budget.

    The first line that doesn't fit is cut to what is left, if that is more than ``least_tail``, and
    nothing follows it. Line breaks between lines don't count. Keys whose lines are all empty have none.
    """
    lines = rows.filter(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("_line", context_line(F.col(ts), F.col(text)))
    sofar = Window.partitionBy(*keys).orderBy(ts, pos).rowsBetween(Window.unboundedPreceding, 0)
    counted = lines.withColumn("_upto", F.sum(F.length("_line")).over(sofar)).withColumn("_before", F.col("_upto") - F.length("_line"))
    left = F.lit(budget) - F.col("_before")
    piece = F.when(F.col("_upto") <= budget, F.col("_line")).when((left >= 0) & (left > least_tail), F.concat(F.substring(F.col("_line"), F.lit(1), left.cast("int")), F.lit("...")))
    kept = counted.withColumn("_piece", piece).filter("_piece is not null")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ts), F.col(pos), F.col("_piece"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["_piece"]), "\n\n").alias("context"))


def candidate_lines(rows: DataFrame, keys: list[str], order: list[str], clip: int = 500, ts: str = "timestamp") -> DataFrame:
    """``prompt`` for each key: a numbered line for every candidate and what to reply."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    body = F.when(F.coalesce(F.col("text"), F.lit("")) != "", clipped(F.col("text"), clip)).otherwise("(picture only)")
    line = F.concat(F.lit("#"), F.col("_n"), F.lit(" "), F.col("source"), F.lit(" at "), minutes_clock(F.col(ts)), F.lit(": "), body)
    numbered = rows.withColumn("_n", place).withColumn("_line", line)
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    ask = F.lit('\nReply with JSON {"selected": [numbers of the 1 to 5 most useful candidates, best first]}.')
    return numbered.groupBy(*keys).agg(F.concat(F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n"), ask).alias("prompt"))


def gather(rows: DataFrame, replied: DataFrame, keys: list[str], order: list[Column], settings: Settings = DEFAULT) -> DataFrame:
    """Rows that ``replied`` (keys, reply) chooses, in the order of the reply, with ``place`` from 1.

    Up to ``rerank_skip`` rows stay as they are. An empty choice gives the first rows; a null reply or
    one that can't be read as indices stands for a failed call and gives the best by score.
    """
    whole = Window.partitionBy(*keys)
    numbered = rows.withColumn("_pos", F.row_number().over(whole.orderBy(*order)) - 1).withColumn("_rows", F.count("*").over(whole))
    numbered = numbered.withColumn("_by_score", F.row_number().over(whole.orderBy(F.col("score").desc(), "_pos")) - 1)
    joined = numbered.join(replied, keys, "left")
    choice = selected(F.col("reply"), F.col("_rows").cast("int"), settings.parse_fallback)
    chosen = joined.withColumn("_choice", F.when(F.col("_rows") > settings.rerank_skip, F.when(F.col("reply").isNotNull(), choice)))
    first = F.array(F.col("_pos").cast("int"))
    places = (
        F.when(F.col("_rows") <= settings.rerank_skip, first)
        .when(F.col("_choice").isNull(), F.array(F.col("_by_score").cast("int")))
        .when(F.size("_choice") == 0, first)
        .otherwise(F.filter(F.sequence(F.lit(0), F.size("_choice") - 1), lambda i: F.element_at(F.col("_choice"), i + 1) == F.col("_pos")))
    )
    out = chosen.select(*rows.columns, F.explode(places).alias("_at")).filter(F.col("_at") < settings.rerank_cap)
    return out.withColumn("place", F.col("_at") + 1).drop("_at")


def rerank(rows: DataFrame, keys: list[str], order: list[Column], model: Callable[[str], str] | None, query: str = "query", settings: Settings = DEFAULT, ledger: str | None = None) -> DataFrame:
    """Re-ranked rows; ``model`` is called once for each different prompt of a key with more than ``rerank_skip`` rows.

    A model that raises counts as a failed call. Without a model every call fails.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(query).alias("_query")).filter(F.col("_n") > settings.rerank_skip)
    asked = candidate_lines(rows, keys, [c for c in ("place", "ord") if c in rows.columns], settings.clip_chars).join(counts, keys)
    asked = asked.select(*keys, F.concat(F.lit("Question: "), "_query", F.lit("\n"), "prompt").alias("prompt"))
    return gather(rows, replies(asked, keys, model, "reply", settings, ledger), keys, order, settings)


def assemble(rows: DataFrame, keys: list[str], place: str = "place", max_images: int = 5) -> DataFrame:
    """Parts of an answer: sorted distinct timestamps, first frame paths, transcript texts and sources in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "timestamp", "source", "score", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("frame_path", F.lit("")).alias("frame_path"))))
    lists = rows.groupBy(*keys).agg(ordered.alias("_r"), F.array_sort(F.collect_set("timestamp")).alias("timestamps"))
    frames = F.filter("_r", lambda r: (r["source"] == "frames") & (r["frame_path"] != ""))
    spoken = F.filter("_r", lambda r: (r["source"] == "transcript") & (r["text"] != ""))
    return lists.select(
        *keys,
        "timestamps",
        F.slice(F.transform(frames, lambda r: r["frame_path"]), 1, max_images).alias("keyframe_paths"),
        F.transform(spoken, lambda r: r["text"]).alias("transcript_used"),
        F.transform("_r", lambda r: F.struct(r["timestamp"].alias("timestamp"), r["source"].alias("source"), r["score"].alias("score"), r["text"].alias("text"), r["frame_path"].alias("frame_path"))).alias("sources"),
    )


def shown_images(parts: DataFrame, files: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """The first ``limit`` frame paths of each answer whose files exist (``files`` has path), with their ``place``."""
    paths = parts.select(*keys, F.posexplode("keyframe_paths").alias("_pos", "path")).join(files.select("path"), "path", "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_pos"))
    return paths.withColumn("place", place).filter(F.col("place") <= limit).drop("_pos")


def prompt_parts(parts: DataFrame, max_images: int = 5) -> DataFrame:
    """``parts`` with ``prompt_parts``: role, context if there is any, up to ``max_images`` pictures, question."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    role = part("text", F.lit("Answer from the excerpts of this recording only, and name the times that you rely on."))
    context = F.when(strip(F.coalesce("context", F.lit(""))) != "", F.array(part("text", F.concat(F.lit("Spoken excerpts:\n"), "context")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    images = F.transform(F.slice("keyframe_paths", 1, max_images), lambda p: F.struct(F.lit("image").alias("kind"), p.alias("value")))
    return parts.withColumn("prompt_parts", F.concat(F.array(role), context, images, F.array(part("text", F.concat(F.lit("Question: "), "query")))))


def loaded_parts(prompts: DataFrame, keys: list[str], pictures: DataFrame) -> DataFrame:
    """``keys`` and ``prompt``: the parts of ``prompt_parts`` in order, pictures with their ``image``.

    ``pictures`` has frame_path and image. A picture that isn't there is left out, after the number of
    pictures was limited.
    """
    parts = prompts.select(*keys, F.posexplode("prompt_parts").alias("_pos", "_part")).select(*keys, "_pos", "_part.kind", "_part.value")
    found = pictures.select(F.col("frame_path").alias("_path"), "image")
    joined = parts.join(found, (F.col("kind") == "image") & (F.col("value") == F.col("_path")), "left").filter("kind <> 'image' or image is not null")
    ordered = F.array_sort(F.collect_list(F.struct("_pos", F.struct("kind", "value", "image").alias("p"))))
    return joined.groupBy(*keys).agg(F.transform(ordered, lambda x: x["p"]).alias("prompt"))


def answers(rows: DataFrame, queries: DataFrame, keys: list[str], model: Callable[[str], str] | None, model_name: str = "", settings: Settings = DEFAULT, pictures: DataFrame | None = None, ledger: str | None = None) -> DataFrame:
    """An answer for every row of ``queries`` (keys, query) from its re-ranked ``rows``.

    Without results it says so; where the model fails it lists the times and the context. With ``pictures``
    (frame_path, image) the model gets a list of parts, else one text in which pictures are named.
    """
    parts = assemble(rows, keys, max_images=settings.max_images)
    context = budgeted_context(rows.filter(F.col("source") == "transcript"), keys, settings.context_chars, settings.min_tail_chars, pos="place")
    full = queries.join(parts, keys, "left").join(context, keys, "left")
    found = F.col("timestamps").isNotNull()
    prompts = prompt_parts(full.filter(found), settings.max_images)
    asked = loaded_parts(prompts, keys, pictures) if pictures is not None else prompts.select(*keys, F.array_join(F.transform("prompt_parts", lambda p: F.concat(F.when(p["kind"] == "image", "[image] ").otherwise(""), p["value"])), "\n\n").alias("prompt"))
    replied = full.join(replies(asked, keys, model, "_reply", settings, ledger), keys, "left")
    times = F.array_join(F.transform("timestamps", minutes_clock), ", ")
    fallback = F.concat(F.lit("The answer couldn't be written. Relevant times: "), times, F.lit("\n\n"), F.coalesce("context", F.lit("")))
    text = F.when(~found, F.lit(NOTHING_FOUND)).otherwise(F.coalesce("_reply", fallback))
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return replied.select(
        *keys, "query", text.alias("response_text"), empty("timestamps", "array<double>"), empty("keyframe_paths", "array<string>"), empty("transcript_used", "array<string>"),
        empty("sources", full.schema["sources"].dataType), F.lit(model_name).alias("model_used"),
    )


def gated(rows: DataFrame, keys: list[str], gate: float = 0.20) -> DataFrame:
    """Rows of the keys whose best score reaches the gate."""
    return rows.withColumn("_best", F.max("score").over(Window.partitionBy(*keys))).filter(F.col("_best") >= gate).drop("_best")
