"""Repeated passages of few sentences lose them all."""

import random

import brute

from cuepoint.llm import sentence_dedup


def _sentence(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n - 1)) + f" e{rng.randrange(10**9)}."


def _cleaned(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in sentence_dedup.remove_repeats(frame).collect()}


def test_two_sentences_of_51_to_78_words(spark):
    rng = random.Random(7)
    docs = []
    for n in range(51, 79):
        passage = _sentence(rng, n // 2) + " " + _sentence(rng, n - n // 2)
        docs += [(2 * n + i, f"{_sentence(rng, 9)} {passage} {_sentence(rng, 9)}") for i in (0, 1)]
    got = _cleaned(spark, docs)
    assert got == brute.sentence_repeats(docs, 2, 20, 20)
    assert all(got[2 * n][2] == 0 and got[2 * n + 1][1:] == (4, 2) for n in range(51, 79))


def test_one_whole_sentence_between_shared_parts(spark):
    rng = random.Random(8)
    passage = f"{_sentence(rng, 15)} {_sentence(rng, 24)} {_sentence(rng, 15)[:-1]}"
    docs = [(i, f"{_sentence(rng, 9)[:-1]} {passage} {_sentence(rng, 9)}") for i in (1, 2)]
    assert _cleaned(spark, docs)[2][1:] == (3, 1)
    short = [(i, f"{_sentence(rng, 12)} Same nineteen words are left {' '.join('abcdefghijklmn')}. {_sentence(rng, 12)}") for i in (1, 2)]
    assert _cleaned(spark, short)[2][2] == 0
