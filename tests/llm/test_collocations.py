"""Phrases of random words against plain counting, bitmaps alone, and odd tables."""

import random
import tracemalloc
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuepoint.llm import _text as T
from cuepoint.llm import collocations as C


def found(spark, docs, parts=3, **options):
    d = spark.createDataFrame(docs, "lang string, text string").withColumn("key", F.lit(1)).withColumn("a", F.lit("x")).repartition(parts)
    return sorted(map(tuple, C.collocations(d, **options).collect()))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["aa", "B", "c", "dé", "日本", "e'f", "x|"]
    gap = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "!"]
    return [(rng.choice(["en", "", None, "und"]), "".join(rng.choice(words) + rng.choice(gap) for _ in range(rng.randrange(n)))) for _ in range(60)]


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (4, 3, 2000), (2, 2, 5), (5, 6, 40)])
def test_random_words(spark, longest, least, top):
    docs = texts(longest, 90)
    assert found(spark, docs, max_words=longest, least=least, top=top) == sorted(brute.collocations(docs, longest, least, top))


def test_shards_change_nothing(spark, monkeypatch):
    docs = [("en" if k % 5 else None, f"some words here and there {i % 7} again some words") for i in range(300) for k in range(2)]
    whole = found(spark, docs, parts=1)
    assert whole == sorted(brute.collocations(docs))
    monkeypatch.setattr(C, "BUCKET_WORDS", 50)
    assert found(spark, docs, parts=17) == whole


def test_bitmaps():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 6, 500)
    codes[rng.random(500) < 0.1] = C._BORDER
    maps = C.Bitmaps(codes, 6)
    two = C.Phrases.single(maps).longer(maps, None)
    three = two.longer(maps, two)
    for phrases, n in ((two, 2), (three, 3)):
        plain = Counter(tuple(codes[i : i + n].tolist()) for i in range(len(codes) - n + 1) if (codes[i : i + n] != C._BORDER).all())
        assert dict(zip(map(tuple, phrases.codes.tolist()), phrases.counts.tolist())) == plain
    kept = two.only(two.counts >= np.median(two.counts))
    names = set(map(tuple, kept.codes.tolist()))
    assert {tuple(x) for x in kept.longer(maps, kept).codes.tolist()} == {x for x in map(tuple, three.codes.tolist()) if x[:2] in names and x[1:] in names}


def test_batches_change_nothing(monkeypatch):
    codes = np.random.default_rng(5).integers(0, 40, 3000)
    maps = C.Bitmaps(codes, 40)
    whole = C.Phrases.single(maps).longer(maps, None)
    monkeypatch.setattr(C, "BATCH", 50)
    monkeypatch.setattr(C, "PAIRS", 64)
    parts = C.Phrases.single(maps).longer(maps, None)
    assert (parts.keys == whole.keys).all() and (parts.counts == whole.counts).all()


def test_hashes_that_clash_are_replaced(spark, monkeypatch):
    docs = texts(9, 80)
    real, asked = C.word_counts, []

    def clashing(cut, seed):
        asked.append(seed)
        counts = real(cut, seed)
        return counts.withColumn("key", F.lit(1).cast("bigint")) if seed == 0 else counts

    monkeypatch.setattr(C, "word_counts", clashing)
    assert found(spark, docs) == sorted(brute.collocations(docs))
    assert asked == [0, 1]


def test_mixed_values_that_clash(spark, monkeypatch):
    """A bucket's phrases are told apart by their words even if their mixed values agree."""
    rows = [np.array([[1, 2], [3, 4], [5, 6]], np.uint64), np.array([[5, 6], [1, 2]], np.uint64)]
    parts = spark.createDataFrame([(0, i, 2, r.astype("<u8").tobytes(), np.full(len(r), 6, "<u4").tobytes()) for i, r in enumerate(rows)], "bucket int, shard bigint, size int, rows binary, counts binary")
    got = C._summed(parts, 10).collect()
    assert sorted((r["keys"], r.a) for r in got if r["keys"]) == [([1, 2], 12), ([5, 6], 12)]
    assert {r.shard: np.unpackbits(np.frombuffer(r.bits, np.uint8)).tolist()[:3] for r in got if r.bits is not None} == {0: [1, 0, 1], 1: [1, 1, 0]}


def test_score_is_exact(spark):
    counts = [(10**12 + 7, 3 * 10**12 + 1, 10**12 + 9), (10**15, 10**15, 10**15), (10, 11, 13)]
    frame = spark.createDataFrame(counts, "a bigint, l bigint, r bigint").select("a", "l", "r", C.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(x.s == 10**6 * x.a * x.a // (x.l * x.r) for x in frame.collect())


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", None), (None, ""), ("de", "...,\n")]) == []
    assert found(spark, [("en", "a b")] * 9) == []
    assert found(spark, [("en", "A b")] * 10 + [("en", None), ("en", "b. a")]) == [("en", 1, "a b", 10, 11, 11, 22, 826446)]
    long = [(None, "p q " * 200_000)]
    assert found(spark, long) == sorted(brute.collocations(long))
    assert len(T.run_hashes(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def test_a_bucket_holds_little_beside_its_phrases(spark):
    """All of a bucket's phrases can be frequent, as they are in a large corpus: sorting them takes no more than a few times their bytes."""
    rng = np.random.default_rng(8)
    rows = np.repeat(rng.integers(0, 2**63, (400_000, 3), np.uint64), 3, axis=0)
    rng.shuffle(rows)
    counts = rng.integers(1, 9, len(rows)).astype("<u4")
    cuts = np.array_split(np.arange(len(rows)), 7)
    group = pa.table({"bucket": pa.array([3] * 7, pa.int32()), "shard": pa.array(range(7), pa.int64()), "size": pa.array([3] * 7, pa.int32()), "rows": pa.array([rows[c].astype("<u8").tobytes() for c in cuts], pa.binary()), "counts": pa.array([counts[c].tobytes() for c in cuts], pa.binary())})
    tracemalloc.start()
    try:
        out = C._added(group, 10)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3.5 * rows.nbytes
    unique, number = np.unique(rows, axis=0, return_inverse=True)
    total = np.bincount(number.ravel(), counts).astype(int)
    found = {tuple(k): a for k, a in zip(out["keys"].to_pylist(), out["a"].to_pylist(), strict=True) if k}
    assert found == {tuple(k): a for k, a in zip(unique.view(np.int64).tolist(), total.tolist(), strict=True) if a >= 10}
    bits = [b for b in out["bits"].to_pylist() if b is not None]
    assert all((np.unpackbits(np.frombuffer(b, np.uint8), count=len(c)).astype(bool) == (total >= 10)[number.ravel()[c]]).all() for b, c in zip(bits, cuts, strict=True))
