"""A ledger of model calls: every different prompt is asked once, and its reply is a row that all else reads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..shared import scratch_path, written

_LEDGER = "call string, reply string"


def _shown(prompt):
    """A prompt of parts as a list of (kind, text or picture)."""
    if prompt is None or isinstance(prompt, str):
        return prompt
    return [(x["kind"], x["image"] if x["kind"] == "image" else x["value"]) for x in prompt]


def _asked(model: Callable, prompt, tries: int, wait: float) -> str | None:
    """The model's reply; null after ``tries`` failures, between which it waits ever longer."""
    for n in range(tries):
        try:
            return model(_shown(prompt))
        except Exception:  # noqa: BLE001  any failure of the model is a failed call
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return None


def opened(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's replies by call; empty where there is none yet."""
    try:
        rows = spark.read.schema(_LEDGER).parquet(ledger)
        rows.limit(0).count()
        return rows
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _LEDGER)


def replies(prompts: DataFrame, keys: list[str], model: Callable | None, name: str, settings: Settings = DEFAULT, ledger: str | None = None) -> DataFrame:
    """``keys`` and the reply to each ``prompt``, as ``name``; null where the call fails. Without a model all fail.

    Prompts are written, and those that differ are asked once each, ``settings.model_threads`` at a time in a
    task. Replies are written before anything reads them, so neither a plan that uses them twice nor a lost
    executor later on asks again; only calls of a task that is lost before it ends are repeated. A ``ledger``
    that is named stays for later runs, which ask for what it doesn't answer.
    """
    if model is None:
        return prompts.select(*keys, F.lit(None).cast("string").alias(name))
    spark = prompts.sparkSession
    asked = written(prompts.withColumn("call", F.sha2(F.to_json(F.struct("prompt")), 256)), "prompts")
    ledger = ledger or scratch_path(spark, "calls")
    new = asked.groupBy("call").agg(F.first("prompt").alias("prompt")).join(opened(spark, ledger).filter("reply is not null"), "call", "left_anti")
    threads, tries, wait = settings.model_threads, settings.model_tries, settings.model_wait_sec

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                found = list(pool.map(lambda p: _asked(model, p, tries, wait), frame["prompt"]))
                yield pd.DataFrame({"call": frame["call"], "reply": found})

    new.mapInPandas(ask, _LEDGER).write.mode("append").parquet(ledger)
    answered = opened(spark, ledger).groupBy("call").agg(F.max("reply").alias(name))
    return asked.select(*keys, "call").join(answered, "call", "left").select(*keys, name)
