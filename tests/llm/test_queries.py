"""Registered corpus queries on the smallest tables against plain versions."""

import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuepoint.llm import queries as Q
from cuepoint.llm import sentence_dedup
from cuepoint.llm._tokens import encoder, vocabulary


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, sf, name):
    return Q.queries()[name](spark, sf).collect()


def ids(text, end):
    tokenizer = encoder(vocabulary("word_bpe_49k.json"))._tokenizer
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_pack(spark, sf, docs):
    rows = run(spark, sf, "op1_pack")
    whole = {d: ids(t, 1) for d, t in docs}
    places: dict[int, list] = {}
    covered = dict.fromkeys(whole, 0)
    for r in rows:
        own = whole[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id])
        covered[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {d: len(w) for d, w in whole.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(map(len, whole.values()))
    assert used > 0.97 * 2048 * (len(places) - 1)


def test_token_output(spark, sf, docs):
    start = 0
    rows = {r.doc_id: r for r in run(spark, sf, "op8_token_output")}
    for d, text in sorted(docs):
        own = ids(text, 2)
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert len(rows) == len(docs)


def test_mix(spark, sf, docs):
    rows = run(spark, sf, "op2_mix")
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes: dict = {}
    for d, text in docs:
        sizes[source[d]] = sizes.get(source[d], 0) + len(brute.WORD.findall(text or ""))
    targets = brute.targets(sizes)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(targets[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
    assert sorted(rows) == sorted(run(spark, sf, "op2_mix"))


def test_ngram_join(spark, sf, docs):
    expected = brute.components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, sf, "op3_ngram_join")} == expected


def test_topk(spark, sf):
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, run(spark, sf, "op4_topk"))) == sorted(brute.top(vectors))


def test_pii(spark, sf, docs):
    text = dict(docs)
    for r in run(spark, sf, "op5_pii"):
        *counts, digest, listed = brute.private(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == [*counts, digest]
        assert not listed or set(listed.split(",")) <= set(r.spans.split(","))


def test_secrets(spark, sf, docs):
    text = dict(docs)
    for r in run(spark, sf, "op6_secrets"):
        *counts, digest, listed = brute.secret(text[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == [*counts, digest]
        assert not listed or set(listed.split(",")) <= set(r.spans.split(","))


def test_sentences(spark, sf, docs):
    expected = brute.sentence_repeats(docs, sentence_dedup.MIN_SENTENCES, sentence_dedup.MIN_WORDS, sentence_dedup.LONG_SENTENCE)
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in run(spark, sf, "op7_sentence_dedup")} == expected


def test_quality(spark, sf, docs):
    text = dict(docs)
    rows = run(spark, sf, "op9_quality")
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [r.kept == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean(right) > 0.9


def test_align(spark, sf, docs):
    assert sorted(map(tuple, run(spark, sf, "op12_align"))) == sorted(brute.alignments(docs))


def test_decontaminate(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = brute.leaks(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in run(spark, sf, "op13_decontaminate")} == expected


def test_suffixes(spark, sf, docs):
    expected = brute.repeats(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, sf, "op10_suffix_dedup")} == expected


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = Q.queries()[name](spark, sf)
    columns = sorted(found.columns)
    relation = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in relation.description]
    assert sorted(names) == columns
    expected = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in relation.fetchall())
    assert sorted(map(tuple, found.select(*columns).collect())) == expected


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_jaccard_join", "pii", "mixing", "packing"]
    from cuepoint.llm._scratch import written

    kept = written(P.quality_rules(spark, docs, sf), "t")
    verdicts = {r.doc_id for r in run(spark, sf, "op9_quality") if r.kept}
    assert {r.doc_id for r in kept.collect()} == verdicts and all(r.asDict() == before[r.doc_id] for r in kept.collect())
    single = written(P.ngram_jaccard_join(spark, kept, sf), "t")
    groups = brute.components([(d, before[d]["text"]) for d in verdicts])
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in groups.items() if c == d}
    masked = written(P.mask_pii(spark, single, sf), "t")
    from cuepoint.llm import pii

    every = {r.doc_id: r.spans for r in pii.digest(pii.find(single)).collect()}
    for r in masked.collect():
        text, listed = before[r.doc_id]["text"], every[r.doc_id]
        assert set(filter(None, brute.private(text)[-1].split(","))) <= set(listed.split(","))
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in listed.split(",") if s)
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert r.text == "".join(out) + text[at:] and r.n_chars == len(r.text)
    mixed = written(P.mix_sources(spark, masked, sf), "t")
    assert mixed.columns == docs.columns == masked.columns == single.columns == kept.columns
    most = max(r["count"] for r in mixed.groupBy("doc_id").count().collect())
    assert most <= 2
    packed = P.pack_sequences(spark, mixed, sf)
    tokens = sum(len(ids(r.text, 1)) for r in mixed.collect())
    assert packed.agg(F.sum("length")).first()[0] == tokens
    assert P.run(spark, sf).count() == packed.count()
