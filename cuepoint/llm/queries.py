"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, decontamination, mixing, ngram_join, packing, pii, quality, secrets, sentence_dedup, sql, suffix_dedup, token_output, topk
from ._scratch import scratch_path
from ._tokens import vocabulary

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(_table(spark, sf_dir, "documents")))


def op7_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = sentence_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_sentences", "n_removed", "n_spans", "removed_spans")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-output")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary(VOCABULARY))
    return token_output.read_tokens(spark, path)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.verdicts(_table(spark, sf_dir, "documents")).select(*columns)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.digest(reported).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": op1_pack,
        "op2_mix": op2_mix,
        "op3_ngram_join": op3_ngram_join,
        "op4_topk": op4_topk,
        "op5_pii": op5_pii,
        "op6_secrets": op6_secrets,
        "op7_sentence_dedup": op7_sentence_dedup,
        "op8_token_output": op8_token_output,
        "op9_quality": op9_quality,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_collocations": op11_collocations,
        "op12_align": op12_align,
        "op13_decontaminate": op13_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": sql.OP2, "op3_ngram_join": sql.OP3, "op4_topk": sql.OP4, "op9_quality": sql.OP9, "op11_collocations": sql.OP11, "op13_decontaminate": sql.OP13}
