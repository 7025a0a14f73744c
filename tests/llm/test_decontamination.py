"""Phrase and proximity matches against plain versions, and odd tables."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuepoint.llm import decontamination as D


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("runs", F.lit("x")).repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    return D.digest(D.report(d, b)).collect()


def plain(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows)


def near(text, item, size=D.WINDOW, slack=D.SLACK):
    w, v = brute.item_words(text), brute.item_words(item)
    for k in range(max(len(v) - size + 1, min(len(v), 1))):
        own = v[k : k + size]
        if any(set(own) <= set(w[i : i + len(own) + slack]) for i in range(len(w))):
            return True
    return False


def test_random_words(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["aa", "B", "c", "dé", "x9"]) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 12, 60, 400]))) for i in range(60)]
    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 14]))) for i in range(40)]
    items += [(100 + i, brute.item_words(t)[20:33].__str__()) for i, t in docs if len(t) > 200]
    expected = brute.leaks(docs, items)
    got = found(spark, docs, items)
    assert plain(got) == sorted((d, *x) for d, x in expected.items())
    text_of = dict(docs)
    for r in got:
        assert r.n_near_items == sum(near(text_of[r.doc_id], t) for _, t in items if brute.item_words(t))


def test_moved_words_are_near(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "so one two three four yes five six seven well eight nine ten it is"), (2, "ten nine eight seven six five four three two one"), (3, "one two three"), (4, item.upper())]
    got = {r.doc_id: (r.contaminated, r.n_near_items) for r in found(spark, docs, [(7, item)])}
    assert got == {1: (False, 1), 2: (False, 1), 3: (False, 0), 4: (True, 1)}


def test_odd_tables(spark):
    docs = [(1, None), (None, "alpha beta"), (2, "alpha beta"), (2, "alpha beta"), (2, ""), (3, "gamma"), (4, "...")]
    items = [(1, "beta"), (1, "gamma"), (None, "alpha"), (2, None), (3, "")]
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found(spark, docs, items)}
    assert got == {(1, 0, 0, 0), (None, 2, 2, 1), (2, 2, 2, 1), (2, 0, 0, 0), (3, 1, 1, 1), (4, 0, 0, 0)}
    assert len(found(spark, docs, items)) == len(docs)
    assert [r.contaminated for r in found(spark, docs, [])] == [False] * len(docs)
    assert found(spark, [], items) == []


def test_bounds_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(20)]
    items = [(i, " ".join(docs[i][1].split()[10 * i : 10 * i + 40])) for i in range(20)]
    expected = plain(found(spark, docs, items))
    assert sum(r[2] > 0 for r in expected) == 20
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(20)
    b = spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    index = D.build_index(d, shard_bytes=1000)
    assert index.count() > 5
    assert plain(D.digest(D.summed(D.matches(index, b, block_words=16, block_bytes=300))).collect()) == expected
    parts = (index.first()[k] for k in range(1, 7))
    lists, words = D._Lists(*parts), np.array([[3, 4], [4, 3], [3, 3]])
    whole = [sorted(zip(*map(np.ndarray.tolist, f(words)))) for f in (lists.phrases, lists.close)]
    monkeypatch.setattr(D, "CANDIDATES", 7)
    assert [sorted(zip(*map(np.ndarray.tolist, f(words)))) for f in (lists.phrases, lists.close)] == whole


def test_long_text(spark):
    text = "v " * 300_000 + "a b c d e f g h i j " + "v " * 300_000
    (row,) = found(spark, [(1, text)], [(1, "a b c d e f g h i j"), (2, "v a b")])
    assert (row.n_words, row.n_hit, row.n_items) == (600_010, 11, 2)


@pytest.mark.parametrize("columns", [["doc_id", "text"], ["shard", "doc", "near", "item_id", "doc_id", "text"]])
def test_other_columns(spark, columns):
    d = spark.createDataFrame([(1, "p q")], "doc_id bigint, text string").select(*[F.col(c) if c in ("doc_id", "text") else F.lit(0).alias(c) for c in columns])
    assert D.report(d, spark.createDataFrame([(5, "q")], "item_id int, text string")).collect()[0].n_hit == 1
