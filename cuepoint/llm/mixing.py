"""Mixing sources to target weights, with DataFrame functions only.

Words are totalled for each source; weights share a budget of words among the sources, and no target
passes twice its source's size: what a source can't take goes to the others by weight. A source's
rate is its target over its size. A document comes floor(rate) times and once more with a
probability equal to the fraction, drawn from a hash of the seed and its id, so reruns agree and a
document's draw doesn't depend on the others.

Cases: a null or empty text has no words and is taken as often as its source's rate says, at no
words; null is a source of its own, last in order; null ids draw from their text instead; rows with
one id share a draw; sources without words have target 0; an empty table gives no rows; other
columns are passed on by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the sources' order, again from the first after the last; all are divisors of 10.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each two words of the corpus, and the most that a source's words repeat.
BUDGET_HALVES, MOST = 3, 2
_DRAWS = 1 << 52


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``; one row for each source.

    Sources sorted by size over weight fill up in that order as the budget rises. The first one whose
    weighted share stays within its limit fixes the level for itself and all after it. Compared in
    whole numbers, so nothing depends on the order of additions.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    whole = lambda c: c.cast("decimal(38,0)")
    weighed = totals.withColumn("weight", weight).withColumn("level", whole(F.col("source_size")) * (F.lit(10) / F.col("weight")).cast("int"))
    upto = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    zero = F.lit(0).cast("decimal(38,0)")
    left = weighed.select(
        "*",
        (BUDGET_HALVES * F.sum(whole(F.col("source_size"))).over(every) - 2 * MOST * F.coalesce(F.sum(whole(F.col("source_size"))).over(upto), zero)).cast("decimal(38,0)").alias("halves"),
        (F.sum(whole(F.col("weight"))).over(every) - F.coalesce(F.sum(whole(F.col("weight"))).over(upto), zero)).cast("decimal(38,0)").alias("weights"),
    )
    fits = F.col("halves") * F.col("weight") <= 2 * MOST * F.col("source_size") * F.col("weights")
    # levels ascend, and once a source fits all later ones do
    first = F.first(F.when(fits, F.struct("halves", "weights")), ignorenulls=True).over(Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    share = (F.col("first.halves") * F.col("weight")).cast("double") / (2 * F.col("first.weights")).cast("double")
    return left.withColumn("first", first).select("source", "source_size", F.when(F.col("first").isNull(), (MOST * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _copies(seed: str, doc_id: Column, text_key: Column) -> Column:
    """How often a document comes: floor(rate), and a hash-seeded draw for the fraction."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.coalesce(doc_id.cast("string"), text_key)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("bigint")
    return (F.floor(rate) + F.when(draw.cast("double") < (rate - F.floor(rate)) * F.lit(float(_DRAWS)), 1).otherwise(0)).cast("bigint")


def plan(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words that the mix takes of it)."""
    text = F.col(text_col)
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size(text).alias("size"), F.when(F.col(id_col).isNull(), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("_key")), "mix-sizes")
    by_source = targets(sizes).withColumnRenamed("source", "_source")
    joined = sizes.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", _copies(seed, F.col("doc_id"), F.col("_key")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as its source's rate says."""
    text = F.col(f"_row.{text_col}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    sizes = rows.select(F.col(f"_row.{source_col}").alias("source"), size(text).alias("size"))
    by_source = written(targets(sizes), "mix-targets").withColumnRenamed("source", "_source")
    joined = rows.join(by_source, F.col(f"_row.{source_col}").eqNullSafe(F.col("_source")))
    copies = _copies(seed, F.col(f"_row.{id_col}"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    repeated = joined.withColumn("_copies", copies).filter("_copies > 0")
    return repeated.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
