"""Ranking metrics with a tolerance in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(retrieved: Column, relevant: Column, tolerance: float) -> Column:
    """For each retrieved time whether any relevant one is within the tolerance, inclusive."""
    return F.transform(retrieved, lambda r: F.exists(relevant, lambda g: F.abs(r - g) <= tolerance))


def query_metrics(rows: DataFrame, k: int = 5, tolerance: float = 30.0, retrieved: str = "retrieved", relevant: str = "relevant") -> DataFrame:
    """``rows`` with hits and the metrics of the first ``k`` retrieved times, not rounded.

    Precision divides by ``k``; recall counts distinct relevant times that were met over all relevant ones.
    """
    first = F.slice(retrieved, 1, k) if k > 0 else F.array().cast("array<double>")
    cut = rows.withColumn("retrieved_timestamps", first).withColumn("hits", hits(F.col("retrieved_timestamps"), F.col(relevant), tolerance))
    met = F.array_distinct(F.filter(relevant, lambda g: F.exists("retrieved_timestamps", lambda r: F.abs(r - g) <= tolerance)))
    n_hits = F.size(F.filter("hits", lambda h: h))
    rank = F.array_position("hits", True)
    return (
        cut.withColumn("precision_at_k", n_hits / k if k > 0 else F.lit(0.0))
        .withColumn("recall_at_k", F.when(F.size(relevant) > 0, F.size(met) / F.size(relevant)).otherwise(0.0))
        .withColumn("reciprocal_rank", F.when(rank > 0, 1.0 / rank).otherwise(0.0))
        .withColumn("hit_at_k", n_hits > 0)
    )


def rounded(metrics: DataFrame) -> DataFrame:
    for c in ("precision_at_k", "recall_at_k", "reciprocal_rank"):
        metrics = metrics.withColumn(c, F.round(c, 4))
    return metrics


def band(hit_rate: Column) -> Column:
    return F.when(hit_rate >= 0.8, "strong").when(hit_rate >= 0.6, "moderate").otherwise("weak")


def macro(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means of the rounded metrics, rounded, and the hit rate's band; no row without queries."""
    mean = lambda c: F.round(F.avg(c), 4)
    per_query = rounded(metrics)
    grouped = per_query.groupBy(*keys) if keys else per_query.groupBy()
    out = grouped.agg(
        F.count("*").alias("num_queries"), mean("precision_at_k").alias("mean_precision_at_k"), mean("recall_at_k").alias("mean_recall_at_k"),
        mean("reciprocal_rank").alias("mrr"), mean(F.col("hit_at_k").cast("double")).alias("hit_rate_at_k"),
    )
    return out.filter("num_queries > 0").withColumn("band", band(F.col("hit_rate_at_k")))
