"""Token alignment against whole-text encoding, and odd texts."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from cuepoint.llm import alignment as A
from cuepoint.llm._tokens import vocabulary

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def aligned(spark, docs, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("slice", F.lit(3)).withColumn("code", F.lit("x")).repartition(2)
    return A.align(d, *PATHS, **options).collect()


def plain(rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted((tuple(r)[:8] for r in rows), key=key)


ODD = [
    "", " ", "  ", "   a", "a ", "a  ", "a   b", "a\tb", "a\t b", "a\n b\n", " \n x", "x  y", "x   y", "﻿ a", "a  b", "don't 12 345's  it'll", "</s> <unk> <0x41> <|endoftext|>",
    "a▁b", "▁", "ab ▁ cd", "é ́a", "日本 語 の", "😀 😀😀", "x\x00 y", "\r\n \r\n", "ａ ﬁ", "a" * 3000, "ab " * 2000, "​ z", "1 2　3 4",
    "a.b,'s c'. x.'s y!z\n", "Ab\ncd\n.e\n\nf g\n 'll-'re", "|a|b | c\n| d |\n", "x'", "a-b'c-d", "\na", "éa,ñ.ü;1.2,a3",
]


def test_odd_texts(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "a b"), (None, "a b"), (7, "again"), (7, "again")]
    assert plain(aligned(spark, docs)) == plain(brute.alignments(docs))


def test_random_texts(spark):
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "the", "Ing", "é", ".", "'s", "12", "\t", "日", " a", " ", "b, "]
    docs = [(i, "".join(rng.choice([*parts, ",", "x", "|", "'ll", "-"]) for _ in range(rng.randrange(40)))) for i in range(300)]
    assert plain(aligned(spark, docs)) == plain(brute.alignments(docs))


@pytest.mark.parametrize("text", ODD)
def test_pieces_are_encoded_alike(text):
    both = A.pair(*PATHS)
    if not text or not both.returns(text):
        return
    found = [p for w in A.words(text) for p in both.cut.split(f" {w}")]
    assert " " + text == "".join(found)
    a, _, b, _ = zip(*both.encode(found))
    assert sum(a, []) == both.a.encode(" " + text, add_special_tokens=False).ids
    assert sum(b, []) == both.b.encode(text)


def test_groups(spark):
    (row,) = aligned(spark, [(1, "the other word")], with_groups=True)
    assert row.groups.count(";") == row.n_groups - 1 and brute.sha(row.groups) == row.groups_sha256


def test_empty_tables(spark):
    assert aligned(spark, []) == []
    assert plain(aligned(spark, [(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
