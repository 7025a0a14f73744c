"""Quality rules with adaptive thresholds.

Each document is measured once. The ratios, in thousandths, of those that pass the base rules go into
sketches for each language and source: counts of equal-width bins, which merge by addition, give every
quantile to one bin and hold at most 1001 rows. A rule's limit is the upper quartile plus ``FENCE`` times
the larger of the quartile distance and the distance from the upper quartile to a higher quantile, for
things that a part of good documents has (repeats). So it follows what is usual in a group and rejects
what lies far outside it, not a fixed share. A group's quantiles are means, weighted by rows, of its own
and ``SHRINK`` rows' worth of its language's, which are drawn to all documents' alike.

Cases: a null or empty text has no words and fails the base rules; null language or source is a
group of its own; repeated rows count as often as they come; an empty table gives no rows; other
columns are passed on by ``measure``, in which counts take the place of columns of their names, and by
``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._scratch import written

#: Ratios in thousandths: numerator, denominator, higher quantile in hundredths.
RULES = {
    "symbols": ("n_symbols", "word_chars", 75),
    "capitals": ("n_capitals", "word_chars", 75),
    "exclaims": ("n_exclaims", "word_chars", 75),
    "repeats": ("n_repeat_words", "n_words", 99),
    "dup_lines": ("n_dup_lines", "n_lines", 99),
}
#: Distances above the upper quartile at which a rule rejects, and the least distance, in thousandths.
FENCE, LEAST = 4, 10
#: Rows that the language's quantiles weigh in a group's, and all documents' in a language's.
SHRINK = 50

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclaims", "n_lines"]
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    texts = len(offsets) - 1
    starts, ends, text = T.words(data, offsets)
    inside = ~T.is_space(data)
    n_words = np.bincount(text, minlength=texts)
    word_chars = T.per_text(inside & ((data & 0xC0) != 0x80), offsets)

    cut = data == 10
    # one line for each break and each text; at a text's end both lists have its border
    line_starts = np.sort(np.concatenate([np.flatnonzero(cut) + 1, offsets[:-1]]))
    line_ends = np.sort(np.concatenate([np.flatnonzero(cut), offsets[1:]]))
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    real = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[real], line_ends[real]
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    salt = T.mix(np.arange(1, texts + 1, dtype=np.uint64))
    lines = T.mix(T.run_hashes(data, line_starts, line_ends) ^ salt[line_text])
    n_lines = np.bincount(line_text, minlength=texts)
    order = np.lexsort((lines, line_text))
    same = (lines[order][1:] == lines[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])
    n_dup_lines = np.bincount(line_text[order][1:][same], minlength=texts)

    found, at = T.windows(T.run_hashes(data, starts, ends), text, 3)
    at = at[T.repeated(T.mix(found ^ salt[text[at]]))]
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[at + k] = True
    n_repeat_words = np.bincount(text[covered], minlength=texts)

    capitals = T.per_text((data >= 65) & (data <= 90), offsets)
    return [n_words, word_chars, T.per_text(_SYMBOLS[data], offsets), n_dup_lines, n_repeat_words, capitals, T.per_text(data == 33, offsets), n_lines]


def measure(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns, without the text unless it is to be kept, and the counts that the rules use."""
    kept = [c for c in docs.columns if c != text_col and c not in _COUNTS]
    source = docs.select(*kept, F.col(text_col).alias("_text"))
    passed = len(kept) + keep_text
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:passed])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measures(data, offsets) for _, data, offsets in T.slices(batch.column(len(kept)))]
            if parts:
                counts = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:passed], *counts], [*kept, *["_text"] * keep_text, *_COUNTS])

    return source.mapInArrow(count, f"{fields}, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.when(F.col(under) > 0, F.least(F.floor(F.lit(1000) * F.col(over) / F.col(under)), F.lit(1000))).otherwise(F.lit(0)).cast("int")


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each sketch, its quartiles and its rule's higher quantile: ``n``, ``low``, ``mid``, ``high``."""
    window = Window.partitionBy(*keys, "rule").orderBy("bin")
    whole = Window.partitionBy(*keys, "rule")
    ranked = sketch.withColumn("upto", F.sum("n").over(window)).withColumn("rows", F.sum("n").over(whole))
    higher = F.create_map(*[x for rule, (_, _, h) in RULES.items() for x in (F.lit(rule), F.lit(h))])[F.col("rule")]
    quantile = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("rows"), F.col("bin"))).cast("double")
    return ranked.groupBy(*keys, "rule").agg(F.max("rows").alias("n"), quantile(F.lit(25)).alias("low"), quantile(F.lit(75)).alias("mid"), quantile(higher).alias("high"))


def judge(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    stack = ", ".join(f"'{r}', _r_{r}" for r in RULES)
    ratios = measured.filter(~base_failed()).select(F.col(lang_col).alias("_l"), F.col(source_col).alias("_s"), *[_ratio(r).alias(f"_r_{r}") for r in RULES])
    sketch = ratios.selectExpr("_l", "_s", f"stack({len(RULES)}, {stack}) as (rule, bin)").groupBy("_l", "_s", "rule", "bin").agg(F.count("*").alias("n"))
    sketch = written(sketch, "quality-sketches")
    by_lang = sketch.groupBy("_l", "rule", "bin").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("rule", "bin").agg(F.sum("n").alias("n"))
    own, lang, everything = _quantiles(sketch, ["_l", "_s"]), _quantiles(by_lang, ["_l"]), _quantiles(by_all, [])

    def drawn(frame: str, name: str, to: Column) -> Column:
        n = F.col(f"{frame}.n").cast("double")
        return (n * F.col(f"{frame}.{name}") + F.lit(float(SHRINK)) * to) / (n + F.lit(float(SHRINK)))

    blended = {x: drawn("own", x, drawn("lang", x, F.col(f"every.{x}"))) for x in ("low", "mid", "high")}
    limits = (
        own.alias("own")
        .join(lang.alias("lang"), F.col("own._l").eqNullSafe(F.col("lang._l")) & (F.col("own.rule") == F.col("lang.rule")))
        .join(everything.alias("every"), F.col("own.rule") == F.col("every.rule"))
        .select("own._l", "own._s", "own.rule", *[c.alias(x) for x, c in blended.items()])
        .select("_l", "_s", "rule", (F.col("mid") + FENCE * F.greatest(F.col("mid") - F.col("low"), F.col("high") - F.col("mid"), F.lit(float(LEAST)))).alias("limit"))
        .groupBy("_l", "_s")
        .agg(*[F.max(F.when(F.col("rule") == r, F.col("limit"))).alias(f"_limit_{r}") for r in RULES])
    )
    # written, so that the planner knows its size before it decides how to join
    limits = written(limits, "quality-limits")
    joined = measured.join(limits, F.col(lang_col).eqNullSafe(F.col("_l")) & F.col(source_col).eqNullSafe(F.col("_s")), "left")
    far = F.lit(False)
    for rule in RULES:
        far = far | (_ratio(rule) > F.coalesce(F.col(f"_limit_{rule}"), F.lit(1000.0)))
    judged = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)
    return judged.select(*measured.columns, "base_failed", "kept")


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rows that the rules reject.

    The verdict depends on a row's text, language and source alone, so it is worked out with the row
    at hand: measures and text stay in one row and no join on the id is needed.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("_row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    kept = judge(measure(rows, keep_text=True)).filter("kept")
    return kept.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each document: its counts, ``base_failed`` and ``kept``."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return judge(written(measure(plain), "quality-measures"))
