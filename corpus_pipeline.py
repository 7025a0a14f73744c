"""Corpus pipeline: quality rules, near-duplicate removal, PII masking, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the
last return the columns of ``documents``; the last returns packed pieces. A stage's intermediate tables and
its input go when its result is written, so at most two copies of the corpus are kept.

Cases: null, empty and short texts fail the quality rules; a row without an id, language or source takes
part, as one of a source and language of its own, and may be packed without an id; of repeated rows, as of
near copies, one stays, and is mixed and packed as often as its source's target asks for; texts of any
length are cut to pieces only by packing; an empty table gives no pieces; columns beyond those of
``documents``, whatever their names, are left out at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuepoint.llm import mixing, ngram_join, packing, pii, quality
from cuepoint.llm._scratch import dropped, step
from cuepoint.llm._tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality.filter_documents(docs.select(*COLUMNS))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    return pii.mask(docs.select(*COLUMNS), size_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and copies with their place in the sequences."""
    return packing.pack(docs.select(*COLUMNS), vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing and the similarity join have no SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, step(spark, lambda rows=docs, stage=stage: stage(spark, rows, sf_dir), f"stage-{name}")
        if n:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
