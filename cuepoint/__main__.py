"""Command line: index, list, rename and delete recordings, ask one or all of them, annotate and evaluate."""

from __future__ import annotations

import argparse
import datetime
import importlib

from pyspark.sql.utils import AnalysisException

from .adapters import query_vectors
from .config import settings
from .operators import registry, search
from .plans import ask, ingest
from .session import session
from .shared import release
from .sinks import tables
from .sources import json_files, media
from .streaming.ingest import index_stream


def _named(path: str):
    """An object given as ``module:attribute``."""
    module, _, attribute = path.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cuepoint")
    parser.add_argument("--folder", default="index", help="folder of the index tables and registry.json")
    parser.add_argument("--frame-model", help="factory of the frame space's text embedder, module:attribute; else that of the models that made the index")
    parser.add_argument("--text-model", help="factory of the transcript space's text embedder, module:attribute; else that of the models that made the index")
    parser.add_argument("--reranker", help="function from a prompt to a reply, module:attribute")
    parser.add_argument("--answerer", help="function from a prompt to an answer, module:attribute")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("evaluate", "annotations"):
        sub = commands.add_parser(name)
        sub.add_argument("--annotations", required=True)
        if name == "evaluate":
            sub.add_argument("--k", type=int, default=5)
            sub.add_argument("--output")
    sub = commands.add_parser("query", help="a question to one recording, or without --video to the whole library")
    sub.add_argument("query")
    sub.add_argument("--video")
    sub.add_argument("--pictures", action="store_true", help="the answerer gets a list of parts with pictures")
    sub = commands.add_parser("rename")
    sub.add_argument("video_hash")
    sub.add_argument("name")
    sub = commands.add_parser("delete")
    sub.add_argument("video_hash")
    sub = commands.add_parser("annotate", help="add annotations of queries; asks for the times of those that have none yet")
    sub.add_argument("video", help="the recording's file name, or a part of it")
    sub.add_argument("--output", required=True)
    sub.add_argument("--queries", nargs="+", required=True)
    sub.add_argument("--no-resume", action="store_true")
    sub = commands.add_parser("index")
    sub.add_argument("path")
    sub.add_argument("--models", required=True, help="a Models object, module:attribute")
    sub.add_argument("--force", action="store_true")
    sub = commands.add_parser("watch", help="index what has landed since the last run; with --seconds go on watching")
    sub.add_argument("path")
    sub.add_argument("--models", required=True, help="a Models object, module:attribute")
    sub.add_argument("--seconds", type=int, help="time between two looks")
    commands.add_parser("list")
    args = parser.parse_args(argv)

    spark = session()
    where = f"{args.folder}/registry.json"
    known = json_files.registry(spark, where)
    options = settings(spark)
    reranker, answerer = (_named(m) if m else None for m in (args.reranker, args.answerer))
    if args.command == "list":
        ask.library_view(known).orderBy("place").show(1000, truncate=False)
    elif args.command in ("rename", "delete"):
        if json_files.lookup(known, args.video_hash).isEmpty():
            raise SystemExit(f"no recording {args.video_hash}")
        if args.command == "rename":
            rows = registry.rename(known, "video_hash", args.video_hash, args.name)
        else:
            rows = tables.delete_videos(spark, [args.video_hash], [f"{args.folder}/{name}" for name in ("frame_index", "chunk_index")], known)
        tables.registry_json(rows, where)
    elif args.command == "annotations":
        ask.shown_annotations(json_files.annotations(spark, args.annotations)).show(1000, truncate=False)
    elif args.command == "annotate":
        _annotate(spark, known, args, options)
    elif args.command == "index":
        _note_models(spark, args)
        ask.library_view(ingest.index_path(spark, args.path, args.folder, _named(args.models), args.force, options)).orderBy("place").show(1000, truncate=False)
    elif args.command == "watch":
        _note_models(spark, args)
        live = index_stream(spark, args.path, args.folder, _named(args.models), f"{args.folder}/_landed", options)
        live = live.trigger(processingTime=f"{args.seconds} seconds") if args.seconds else live.trigger(availableNow=True)
        live.start().awaitTermination()
    else:
        frames, chunks = ingest.search_tables(spark, args.folder)
        if args.command == "query":
            asked = search.asked(spark.createDataFrame([("q", args.query)], "query_id string, query string"))
            if asked.isEmpty():
                raise SystemExit("the question is blank")
            asked = query_vectors(asked, "query", *_embedders(spark, args))
            pictures = media.pictures(spark, f"{args.folder}/keyframes") if args.pictures else None
            if args.video:
                found = ask.ask(frames, chunks, asked, args.video, reranker, answerer, options, pictures=pictures)
            else:
                found = ask.ask_library(frames, chunks, asked, known, reranker, answerer, options, pictures=pictures).orderBy("video_place")
            ask.answer_view(found).show(truncate=False, vertical=True)
        else:
            annotated = json_files.annotations(spark, args.annotations)
            vectors = query_vectors(annotated.select("query").distinct(), "query", *_embedders(spark, args))
            rows = ask.evaluate(annotated, frames, chunks, vectors, reranker, args.k, options)
            ask.summary_lines(rows, ask.means(rows, args.k)).show(100, truncate=False)
            if args.output:
                tables.one_json(ask.report(rows, args.k), args.output)
    release(spark)


def _noted_models(spark, folder: str) -> str | None:
    """The name of the models that made the index, if it's known."""
    try:
        noted = spark.read.schema("models string").json(f"{folder}/models.json").first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return noted and noted["models"]


def _note_models(spark, args) -> None:
    """Keep the models' name with the index; vectors of other models aren't added to it."""
    noted = _noted_models(spark, args.folder)
    if noted and noted != args.models:
        raise SystemExit(f"the index was made with {noted}; vectors of {args.models} can't be compared with its own")
    if not noted:
        tables.one_json(spark.createDataFrame([(args.models,)], "models string"), f"{args.folder}/models.json")


def _embedders(spark, args) -> tuple:
    """What embeds questions in both spaces: as named, or as the models that made the index have it."""
    noted = None if args.frame_model and args.text_model else _noted_models(spark, args.folder)
    models = _named(noted) if noted else None
    frame_model = _named(args.frame_model) if args.frame_model else getattr(models, "question_vectors", None)
    text_model = _named(args.text_model) if args.text_model else getattr(models, "text_vectors", None)
    missing = [option for option, model in (("--frame-model", frame_model), ("--text-model", text_model)) if model is None]
    if missing:
        raise SystemExit(f"name {' and '.join(missing)}: the index doesn't say what embeds questions")
    return frame_model, text_model


def _annotate(spark, known, args, options) -> None:
    """Ask for the times and notes of each query that has none, and write the file anew."""
    matched = registry.match_names(known, [args.video], "video_name", "date_indexed")
    video = known.join(matched.select("video_name"), "video_name", "left_semi").limit(1)
    if video.isEmpty():
        raise SystemExit(f"no recording like {args.video}")
    try:
        existing = json_files.annotations(spark, args.output)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing = spark.createDataFrame([], "video_hash string, video_name string, video_path string, annotated_at string, tolerance double, pos int, query string, relevant_timestamps array<double>, notes string")
    wanted = spark.createDataFrame(list(enumerate(args.queries)), "pos int, query string")
    left = wanted if args.no_resume else ask.to_annotate(wanted, existing)
    given = []
    for row in left.orderBy("pos").toLocalIterator():
        given.append((row["pos"], row["query"], input(f"{row['query']}\n  times (73, 1:13, 1:02:03): "), input("  notes: ")))
    rows = spark.createDataFrame(given, "pos int, query string, times string, notes string")
    now = datetime.datetime.now().isoformat(timespec="seconds")
    tables.swapped_json(ask.annotate(video, existing, rows, now, options.tolerance_sec, not args.no_resume), args.output)


if __name__ == "__main__":
    main()
