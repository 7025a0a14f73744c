"""Reading the reply of a re-ranking model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(reply: Column) -> Column:
    """The reply without a code fence: its first line, and its last where that is a fence too."""
    text = F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)^```[^\n]*(?:\n|$)", ""), r"(?s)(?:^|\n)```\s*$", "")
    return F.when(F.startswith(text, F.lit("```")), F.regexp_replace(body, r"(?U)^\s+|\s+$", "")).otherwise(text)


def selected(reply: Column, candidates: Column, fallback: int = 3) -> Column:
    """Indices that a reply like ``{"selected": [0, 2]}`` chooses among so many candidates.

    Numbers are cut towards zero and true counts as 1; other elements and indices out of range are
    skipped, repeated ones stay. No JSON object, or no list in it, gives the first ``fallback``
    candidates; an object without the key gives none. Null stands for replies that a caller should
    treat as a failed call: a list at the top, or a number that no index can hold.
    """
    value = F.try_parse_json(unfenced(reply))
    kind = F.schema_of_variant(value)
    first = F.when(candidates > 0, F.sequence(F.lit(0), F.least(candidates, F.lit(fallback)) - 1)).otherwise(F.array().cast("array<int>"))
    items = F.try_variant_get(value, "$.selected", "array<variant>")
    whole = lambda v: F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    numbers = F.filter(F.transform(items, whole), lambda x: x.isNotNull())
    cut = F.transform(numbers, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
    inside = F.transform(F.filter(cut, lambda x: (x >= 0) & (x < candidates)), lambda x: x.cast("int"))
    missing = F.try_variant_get(value, "$.selected", "variant").isNull()
    return (
        F.when(value.isNull(), first)
        .when(kind.startswith("ARRAY"), F.lit(None).cast("array<int>"))
        .when(~kind.startswith("OBJECT"), first)
        .when(missing, F.array().cast("array<int>"))
        .when(items.isNull(), first)
        .when(F.exists(numbers, lambda x: F.abs(x) == float("inf")), F.lit(None).cast("array<int>"))
        .otherwise(inside)
    )
