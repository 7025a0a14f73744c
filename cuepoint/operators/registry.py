"""The registry of indexed videos: upserts, edits, listings and lookups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..shared import written


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], sequence: Column | None = None) -> DataFrame:
    """Rows of both, the last one of each key: incoming rows over current ones, later over earlier by ``sequence``."""
    order = sequence if sequence is not None else F.lit(0)
    both = current.withColumn("_late", F.lit(0)).unionByName(incoming.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_late").desc(), order.desc()))
    return both.withColumn("_place", place).filter("_place = 1").drop("_place", "_late")


def register(registry: DataFrame, results: DataFrame) -> DataFrame:
    """New results in the registry. A video that is there already keeps the name that a user gave it."""
    named = registry.select("video_hash", F.col("custom_name").alias("_given"))
    fresh = results.join(named, "video_hash", "left").withColumn("custom_name", F.coalesce("_given", F.lit(""))).drop("_given")
    return upsert(registry, fresh, ["video_hash"])


def rename(registry: DataFrame, key: str, value: object, name: str, column: str = "custom_name") -> DataFrame:
    return registry.withColumn(column, F.when(F.col(key) == F.lit(value), strip(F.lit(name))).otherwise(F.col(column)))


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those of the deleted keys; used for the registry and both indexes alike."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def pending(incoming: DataFrame, registry: DataFrame, key: str = "video_hash", force: bool = False) -> DataFrame:
    """Videos that are not indexed yet; all of them if forced."""
    return incoming if force else incoming.join(registry.select(key), key, "left_anti")


def ranked(rows: DataFrame, coarse: Column, order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in a total order whose first key, descending, is ``coarse``.

    Rows are dealt by ranges of the whole order, from a sample, and sorted within them; what stands before a
    range follows from the ranges' counts, one number for each partition. The sorted rows are written, as the
    ranges of a second run may differ, so no task sorts all rows, however many or few values a key has.
    """
    keys = [coarse.desc_nulls_last(), *order]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    # the number of the partition above 33 bits of the row's number in it
    numbered = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r["part"]: r["n"] for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    offset = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before]), part.cast("int") + 1) if before else F.lit(0).cast("bigint")
    return numbered.withColumn("place", offset + within + 1).drop("_at")


def not_done(queries: DataFrame, done: DataFrame, key: str = "query") -> DataFrame:
    """Queries that have no annotation yet; repeated ones stay repeated."""
    return queries.join(done.select(key), key, "left_anti")


def _stem(name: Column) -> Column:
    """A file's name without its ending."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def match_names(registry: DataFrame, names: list[str], name: str, order: str) -> DataFrame:
    """For each of a few given names the first registered one that equals it or whose stem holds its stem, or the reverse.

    The names are constants of the plan; each row is held against them where it is read.
    """
    wanted = F.explode(F.array(*[F.lit(n) for n in names])) if names else F.explode(F.array().cast("array<string>"))
    pairs = registry.withColumn("wanted", wanted)
    a, b = _stem(F.col(name)), _stem(F.col("wanted"))
    near = pairs.filter((F.col(name) == F.col("wanted")) | F.contains(a, b) | F.contains(b, a))
    return near.groupBy("wanted").agg(F.min(F.struct(order, name)).alias("_m")).select("wanted", F.col(f"_m.{order}"), F.col(f"_m.{name}"))

#: Characters of a gram by which names are looked up.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _held(holders: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs (holder, needle) of the rows' stems in which the first holds the second, for needles longer than a gram.

    A needle is looked up by the rarest of its grams among the holders; what is found is compared in full.
    """
    postings = holders.select(F.col("stem").alias("holder"), F.explode(_grams(F.col("stem"), GRAM)).alias("_gram"))
    counts = postings.groupBy("_gram").agg(F.count("*").alias("_n"))
    own = needles.filter(F.length("stem") > GRAM).select(F.col("stem").alias("needle"), F.explode(_grams(F.col("stem"), GRAM)).alias("_gram"))
    rarest = own.join(counts, "_gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    sought = rarest.filter("_r.n > 0").select("needle", F.col("_r._gram").alias("_gram"))
    return postings.join(sought, "_gram").filter(F.contains("holder", "needle")).select("holder", "needle")


def match_name_table(registry: DataFrame, wanted: DataFrame, name: str, order: str, column: str = "wanted") -> DataFrame:
    """For each different name of a table the first registered one whose stem holds its stem, or the reverse.

    Both sides are tables. Stems of up to ``GRAM`` characters are grams themselves, so they meet the first registered
    name of each gram, and not every name that holds them; longer ones are looked up by their rarest gram and
    compared in full. An empty stem is held by all, so it meets one name only. Equal stems are looked up once.
    Null names match nothing; names without a match have no row, as in ``match_names``.
    """
    first = F.min(F.struct(F.col(order).alias("order"), F.col(name).alias("name"))).alias("first")
    known = written(registry.filter(F.col(name).isNotNull()).groupBy(_stem(F.col(name)).alias("stem")).agg(first), "stems")
    names = written(wanted.filter(F.col(column).isNotNull()).select(F.col(column).alias("wanted"), _stem(F.col(column)).alias("stem")).distinct(), "names")
    asked = names.select("stem").distinct()
    least = F.min("first").alias("first")
    short = F.length("stem").between(1, GRAM)
    sizes = range(1, GRAM + 1)

    def grams(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(F.explode(F.concat(*[_grams(F.col("stem"), n) for n in sizes])).alias("gram"), "stem", *more)

    found = [
        # names that registered ones hold: short, long
        grams(known, "first").groupBy("gram").agg(least).join(asked.filter(short).withColumnRenamed("stem", "gram"), "gram").select(F.col("gram").alias("stem"), "first"),
        _held(known, asked).join(known, F.col("holder") == F.col("stem")).select(F.col("needle").alias("stem"), "first"),
        # names that hold registered ones: short, long
        grams(asked).join(known.filter(short).select(F.col("stem").alias("gram"), "first"), "gram").select("stem", "first"),
        _held(asked, known).join(known, F.col("needle") == F.col("stem")).select(F.col("holder").alias("stem"), "first"),
        # empty on one side: one row meets all
        asked.filter("stem = ''").crossJoin(F.broadcast(known.agg(least))).filter("first is not null"),
        asked.crossJoin(F.broadcast(known.filter("stem = ''").agg(least))).filter("first is not null"),
    ]
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    best = union.groupBy("stem").agg(least)
    return names.join(best, "stem").select("wanted", F.col("first.order").alias(order), F.col("first.name").alias(name))
