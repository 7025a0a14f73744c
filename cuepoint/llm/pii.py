"""Personal data by weak supervision, with DataFrame functions only.

Strict patterns give the base spans, which always stay. Wider patterns give candidates. Four labelers vote
on base spans and candidates alike, on the value without its disguise: a regular expression of what is
valid (with the check digit of cards), a gazetteer of prefixes and domains in use, the words before the
span, for or against, and its borders. Votes are counted by kind, votes and features of the span.
Expectation maximisation on those counts estimates how reliable each labeler is for each kind; base spans
teach what true spans look like and don't enter the share of true candidates, so their number doesn't
decide. A logistic span classifier on votes and features (length, shape, neighbours) is then trained on
the resulting probabilities, and what it is sure of is added.

The driver sees counts only: at most 4 kinds x 24 votes x 3 lengths x 3 shapes x 4 x 4 neighbours x 2.

Positions are code points. Starts are running sums of the lengths of what lies between matches and of
the matches; possessive quantifiers keep long runs linear and off the stack.

Cases: null and empty texts have no spans; overlapping spans are masked together; null ids, repeated
rows and an empty table need no care, as each row is worked on alone; columns are passed on by ``mask``.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written

KINDS = ("email", "ip", "card", "phone")

# In each pattern a match that begins inside a run can only follow a match that ended there: if the
# run's first position fails, so do the others, and looking behind saves trying them.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A quick look that texts without any match of the kind fail.
_HINT = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){13}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_V6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
_DOT = r"(?:\[\.\]|\(\.\))"
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?: ?(?:\(at\)|\[at\]|\{{at\}}) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{{dot\}}) ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": rf"(?<![0-9A-Fa-f:.])(?:{_V6})(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ ./_-]?[0-9]{4}[ ./_-]?[0-9]{4}[ ./_-]?[0-9]{1,7}|3[47][0-9]{2}[ ./_-][0-9]{6}[ ./_-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}[ .()-][0-9 ().-]{6,16}[0-9]|0[1-9][0-9]{1,3}[ /-][0-9]{5,8})(?![0-9])",
}
_WIDE_HINT = {"email": r"[(\[{]at[)\]}]| dot ", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f:]|[0-9][\[(]\.", "card": r"[0-9]{4}[ ./_-]?[0-9]{4}|3[47][0-9]{2}[ ./_-]", "phone": r"[0-9]{3}[ .-][0-9]{4}|00[1-9]|0[1-9][0-9]{1,3}[ /-][0-9]{5}"}
# What the regular expressions and the gazetteers hold of a value without its disguise; fixed values.
_VALID = {
    "email": r"^[a-z0-9_+-](?:\.?[a-z0-9_%+-]){0,63}@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}$",
    "ip": rf"^(?:(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])(?:\.(?!$)|$)){{4}}|{_V6})$",
    "card": r"^[0-9]{13,19}$",
    "phone": r"^(?:\+[1-9][0-9]{7,14}|n[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{6,11})$",
}
_USED = {
    "email": r"\.(?:com|org|net|edu|gov|mil|int|info|biz|name|dev|app|[a-z]{2})$",
    "ip": r"^(?!127\.)(?:(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|[23][0-9a-f]{3}:|f[cde][0-9a-f]{2}:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6(?:011|22|4|5))",
    "phone": r"^(?:\+(?:1[2-9]|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[1-9]|9[0-9])|n[2-9](?!9)[0-9](?!11)|0[1-9])",
}
_CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bips?\b|address|host|server|client|login|adresse|gateway)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|master|credit|payment|karte|tarjeta|carte|amex)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|\btel|call|mobile|fax|cell|dial|sms|telefon|llame|appel|reach)[^\n]{0,24}$",
}
_AGAINST = {
    "email": r"(?i)(?:decorator|handle|version)[^\n]{0,12}$",
    "ip": r"(?i)(?:version|release|build|section|chapter|firmware|namespace|\bkey\b)[^\n]{0,12}$",
    "card": r"(?i)(?:order|invoice|tracking|serial|isbn|parcel|\bid\b|reference|batch|timestamp)[^\n]{0,16}$",
    "phone": r"(?i)(?:order|invoice|tracking|serial|isbn|part|model|ticket|\bid\b|reference|batch|grid)[^\n]{0,16}$",
}
LABELERS = ("regex", "gazetteer", "context", "borders")
#: Characters before a span in which the context labeler looks.
CONTEXT = 40
#: Probability from which the classifier adds a candidate.
SURE = 0.6
_GROUP = 64


def _before(values: Column, zero: Column, join) -> Column:
    """For each element what ``join`` makes of all elements before it, in groups so that long arrays stay cheap."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / F.lit(_GROUP)).cast("int"), F.lit(1)) - 1), lambda g: F.slice(values, g * _GROUP + 1, _GROUP))
    whole = lambda array: F.aggregate(array, zero, join)
    return F.flatten(
        F.transform(groups, lambda group, g: F.transform(F.sequence(F.lit(0), F.size(group) - 1), lambda i: join(whole(F.transform(F.slice(groups, F.lit(1), g), whole)), whole(F.slice(group, F.lit(1), i)))))
    )


def _matches(text: Column, pattern: str, found: Column) -> Column:
    """All matches, leftmost and not overlapping, where ``found`` holds: structs of start, end (exclusive) and value."""
    none = F.array().cast("array<string>")
    gaps = F.when(found, F.split(text, pattern, -1)).otherwise(none)
    hits = F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    begun = F.transform(hits, lambda h, i: F.struct(F.length(gaps[i]).alias("gap"), F.length(h).alias("own"), h.alias("value")))
    before = F.when(F.size(begun) > 0, _before(F.transform(begun, lambda x: x["gap"] + x["own"]), F.lit(0), lambda a, b: a + b)).otherwise(F.array().cast("array<int>"))
    return F.zip_with(begun, before, lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["own"]).alias("end"), x["value"].alias("value")))


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    digit = lambda i: F.substring(turned, i + 1, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda t, i: t + F.when(i % 2 == 1, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a base match of the kind stays."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.length(p) <= 3
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: small(p) & (F.when(small(p), p).otherwise("999").cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _base(text: Column, digits: Column) -> Column:
    """Base spans: structs of start, order of the kind, end, kind. Texts without a digit hold addresses at most."""
    spans = []
    for order, kind in enumerate(KINDS):
        may = {"email": F.contains(text, F.lit("@")), "phone": digits & F.contains(text, F.lit("+"))}.get(kind, digits)
        kept = F.filter(_matches(text, BASE[kind], may & text.rlike(_HINT[kind])), lambda m: _holds(kind, m["value"]))  # noqa: B023
        spans.append(F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"))))  # noqa: B023
    return F.array_sort(F.concat(*spans))


def _plain(kind: str, value: Column) -> Column:
    """The value without disguise and separators."""
    if kind == "email":
        at = F.regexp_replace(F.lower(value), r" ?[(\[{]at[)\]}] ?| at ", "@")
        return F.regexp_replace(at, r" ?[(\[{]dot[)\]}] ?| dot ", ".")
    if kind == "ip":
        return F.regexp_replace(F.lower(value), _DOT, ".")
    digits = F.regexp_replace(value, "[^0-9+]", "")
    if kind == "phone":  # n marks numbers in the form of a three-digit area code, which begin with no 0
        national = value.rlike(r"^\(?[0-9]{3}[) .-]+[0-9]{3}[ .-][0-9]{4}$")
        return F.when(national, F.concat(F.lit("n"), digits)).otherwise(F.regexp_replace(digits, "^00", "+"))
    return digits


def _neighbour(c: Column) -> Column:
    return F.when(c == "", "^").when(c.rlike(r"\s"), "s").when(c.rlike(r"[\p{L}\p{N}_]"), "w").otherwise("p")


def _votes(kind: str, text: Column, m: Column) -> Column:
    """``kind:votes:features``: votes of the labelers as +, - and 0, then length, shape and neighbours."""
    plain = _plain(kind, m["value"])
    context = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
    left = F.substring(text, F.greatest(m["start"], F.lit(1)), F.when(m["start"] > 0, 1).otherwise(0))
    right = F.substring(text, m["end"] + 1, F.lit(1))
    valid = plain.rlike(_VALID[kind])
    if kind == "card":
        valid = F.when(valid, _luhn(plain)).otherwise(False)
    vote = lambda yes: F.when(yes, "+").otherwise("-")
    told = F.when(context.rlike(_AGAINST[kind]), "-").when(context.rlike(_CUES[kind]), "+").otherwise("0")
    edges = vote((_neighbour(left) != "w") & (_neighbour(right) != "w"))
    size = F.length(m["value"])
    length = F.when(size <= 12, "s").when(size <= 19, "m").otherwise("l")
    shape = F.when(m["value"].rlike("^[0-9]+$"), "d").when(m["value"].rlike("[A-Za-z]"), "a").otherwise("n")
    return F.concat(F.lit(kind + ":"), vote(valid), vote(plain.rlike(_USED[kind])), told, edges, F.lit(":"), length, shape, _neighbour(left), _neighbour(right))


def _candidates(text: Column, base: Column, digits: Column) -> Column:
    """Wider matches that touch no base span, with their votes and features."""
    found = []
    for order, kind in enumerate(KINDS):
        may = F.lit(True) if kind == "email" else digits | F.contains(text, F.lit("::")) if kind == "ip" else digits
        wide = F.filter(_matches(text, WIDE[kind], may & text.rlike(_WIDE_HINT[kind])), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        found.append(F.transform(wide, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"), _votes(kind, text, m).alias("votes"))))  # noqa: B023
    return F.concat(*found)


def _base_votes(text: Column, base: Column) -> Column:
    """Votes and features of the base spans, on which the model is anchored."""
    votes = lambda b: F.struct(b["start"], b["end"], F.substring(text, b["start"] + 1, b["end"] - b["start"]).alias("value"))
    choice = F.lit(None).cast("string")
    return F.transform(base, lambda b: F.coalesce(*[F.when(b["kind"] == kind, _votes(kind, text, votes(b))) for kind in KINDS], choice))


def _found(frame: DataFrame, text: str) -> DataFrame:
    """``frame`` with ``_base``, ``_candidates`` and ``_votes``."""
    body = F.coalesce(F.col(text), F.lit(""))
    based = frame.withColumn("_digits", body.rlike("[0-9]")).withColumn("_base", _base(body, F.col("_digits")))
    with_candidates = based.withColumn("_candidates", _candidates(body, F.col("_base"), F.col("_digits")))
    return with_candidates.withColumn("_votes", F.when(F.size("_base") > 0, _base_votes(body, F.col("_base"))).otherwise(F.array().cast("array<string>"))).drop("_digits")


#: What labelers are taken for before any count, as votes of each kind on true and on false spans: better
#: than chance, and outweighed by some tens of spans.
_PRIOR = {k: {"+": (8.0, 3.0), "-": (2.0, 7.0)} for k in LABELERS}
#: Spans that a kind's share of true candidates is worth before any count: true, false.
_SHARE = (5.0, 5.0)


def estimate(counts: dict[tuple[str, bool], int], rounds: int = 60) -> dict[str, float]:
    """Probability that a candidate with each pattern's votes is true, after expectation maximisation.

    ``counts`` holds how often each ``(kind:votes:features, anchored)`` comes; anchored spans are certain
    and teach reliabilities, but don't enter the share of true candidates. Labelers are taken as
    independent given the truth, for each kind on its own; 0 is no vote.
    """
    merged: dict[tuple[str, str, bool], int] = defaultdict(int)
    for (pattern, anchored), n in counts.items():
        kind, word = pattern.split(":")[:2]
        merged[kind, word, anchored] += n
    rows = sorted(merged)
    belief = {x: 1.0 if x[2] else 0.5 for x in rows}

    def odds(kind: str, word: str, mass: dict, votes: dict, whole: dict) -> float:
        own = math.log(mass[kind][1] / mass[kind][0])
        for k, v in enumerate(word):
            if v == "0":
                continue
            own += math.log(votes[kind, k, v][1] / whole[kind, k][1]) - math.log(votes[kind, k, v][0] / whole[kind, k][0])
        return own

    for turn in range(rounds + 1):
        mass = defaultdict(lambda: [_SHARE[1], _SHARE[0]])
        votes = {(kind, k, v): [no, yes] for kind in KINDS for k, name in enumerate(LABELERS) for v, (yes, no) in _PRIOR[name].items()}
        whole = {(kind, k): [sum(x) for x in zip(*_PRIOR[name].values(), strict=True)][::-1] for kind in KINDS for k, name in enumerate(LABELERS)}
        for x in rows if turn else [x for x in rows if x[2]]:
            kind, word, anchored = x
            for c, p in ((1, belief[x]), (0, 1 - belief[x])):
                if not anchored:
                    mass[kind][c] += merged[x] * p
                for k, v in enumerate(word):
                    if v != "0":
                        votes[kind, k, v][c] += merged[x] * p
                        whole[kind, k][c] += merged[x] * p
        for x in rows:
            if not x[2]:
                belief[x] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds(x[0], x[1], mass, votes, whole)))))
    return {p: 1.0 if anchored else belief[(*p.split(":")[:2], False)] for p, anchored in sorted(counts, key=lambda x: -x[1])}


def train(counts: dict[tuple[str, bool], int], belief: dict[str, float], steps: int = 500, rate: float = 1.0, decay: float = 0.002) -> dict[str, float]:
    """Weights of a logistic classifier of spans on kind, votes and features, fitted to the probabilities.

    A pattern weighs by the logarithm of how often it comes, so rare ones are heard beside common ones.
    """
    rows = [(_features(p), math.log1p(n), 1.0 if anchored else belief[p]) for (p, anchored), n in sorted(counts.items())]
    total = sum(n for _, n, _ in rows) or 1.0
    weights: dict[str, float] = defaultdict(float)
    for _ in range(steps):
        slope: dict[str, float] = defaultdict(float)
        for features, n, target in rows:
            off = n / total * (_logistic(sum(weights[f] for f in features)) - target)
            for f in features:
                slope[f] += off
        for f, s in slope.items():
            weights[f] -= rate * (s + decay * weights[f])
    return dict(weights)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _features(pattern: str) -> list[str]:
    kind, word, span = pattern.split(":")
    votes = [f"{name}={v}" for name, v in zip(LABELERS, word, strict=True)]
    own = [f"{name}={v}" for name, v in zip(("length", "shape", "left", "right"), span, strict=True)]
    return ["bias", f"kind={kind}", *votes, *(f"{kind}&{v}" for v in votes), *own]


def score(weights: dict[str, float], pattern: str) -> float:
    return _logistic(sum(weights.get(f, 0.0) for f in _features(pattern)))


def fit(found: DataFrame) -> list[str]:
    """Patterns that the trained classifier accepts; everything is counted in the cluster."""
    votes = found.select(F.explode("_votes").alias("votes"), F.lit(True).alias("anchored"))
    votes = votes.unionByName(found.select(F.explode("_candidates.votes").alias("votes"), F.lit(False).alias("anchored")))
    counts = {(r["votes"], r["anchored"]): r["n"] for r in votes.groupBy("votes", "anchored").agg(F.count("*").alias("n")).collect()}
    return accepted_patterns(counts)


def accepted_patterns(counts: dict[tuple[str, bool], int]) -> list[str]:
    candidates = sorted(p for p, anchored in counts if not anchored)
    weights = train(counts, estimate({x: n for x, n in counts.items()})) if candidates else {}
    return [p for p in candidates if score(weights, p) >= SURE]


def _accepted(accepted: list[str]) -> Column:
    plain = lambda c: F.struct(c["start"].alias("start"), c["order"].alias("order"), c["end"].alias("end"), c["kind"].alias("kind"))
    if not accepted:
        return F.col("_base")
    return F.array_sort(F.concat(F.col("_base"), F.transform(F.filter(F.col("_candidates"), lambda c: c["votes"].isin(accepted)), plain)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, ``base`` and ``spans`` (arrays of start, order, end, kind)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found = written(_found(rows, "_text").select("doc_id", "_base", "_candidates", "_votes"), "pii-spans")
    return found.select("doc_id", F.col("_base").alias("base"), _accepted(fit(found)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, all spans as text and their number."""
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    listed = F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, listed, _listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def mask(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``size_col`` is set to the new length.

    Rows and what was found in them are written once; the model and the masked texts come from that copy.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    found = written(_found(rows, "_text"), "pii-rows")
    text = F.col("_text")
    reach = _before(F.transform("_spans", lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    piece = lambda s, r: F.when(s["start"] >= r, F.concat(F.substring(text, r + 1, s["start"] - r), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
    tail = F.substring(text, F.array_max(F.transform("_spans", lambda s: s["end"])) + 1, F.length(text))
    masked = F.when(F.size("_spans") > 0, F.concat(F.array_join(F.zip_with("_spans", reach, piece), ""), tail)).otherwise(text)
    out = found.select("_row", "_text", _accepted(fit(found)).alias("_spans")).select("_row", F.size("_spans").alias("_n"), masked.alias("_masked"))
    new = {text_col: F.col("_masked")} | ({size_col: F.when(F.col("_n") > 0, F.length("_masked").cast("bigint")).otherwise(F.col(f"_row.`{size_col}`"))} if size_col in docs.columns else {})
    return out.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
