"""Corpus operators on small tables with nulls, empty and long texts, repeats, odd columns and no rows."""

import base64
import gzip
import random
import urllib.parse

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuepoint.llm import mixing, ngram_join, packing, pii, quality, secrets, sentence_dedup, suffix_dedup, token_output, topk
from cuepoint.llm._tokens import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, node bigint, rank string, spans string, n_words string, target string"
VOCABULARY = vocabulary("word_bpe_49k.json")


def prose(seed, words, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eins", "Zwei", "drei.", "vier,", "fünf"]) + str(rng.randrange(n)) for _ in range(words))


def rows():
    base = prose(1, 120)
    near = base.split(" ")
    near[50] = "changed"
    texts = [
        (1, base), (2, None), (3, ""), (4, "  \n\t "), (5, "one"), (6, "one two three"), (7, base), (8, " ".join(near)), (9, base.upper()), (10, prose(2, 30_000)),
        (11, "x" * 150_000), (12, "\n".join(["same line of words here."] * 60)), (13, "mail a@b.co 10.0.0.1 +1 (555) 123-4567 and 4111 1111 1111 1111"), (None, prose(3, 60)), (None, None), (14, "émoji 😀 " * 30), (12, prose(4, 80)),
        (15, "One two. " * 3), (1, base),
    ]
    return [(d, t, None if i % 5 == 4 else "en", None if i % 4 == 3 else f"s{i % 3}", i, 7, 8, "r", "s", "w", "t") for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(table):
    return table.filter("false")


def unique(table):
    """Rows of one id each, without null ids, for comparison with plain versions."""
    found = {}
    for r in table.collect():
        if r.doc_id is not None and r.doc_id != 12:
            found.setdefault(r.doc_id, r.text)
    return sorted(found.items())


def test_pack(table, empty):
    got = packing.pack(table, VOCABULARY, with_ids=True).collect()
    assert sum(r.start == 0 for r in got) == table.count()
    assert packing.pack(empty, VOCABULARY).collect() == []
    assert all(len(r.ids) == 4 * r.length for r in got)
    blank = [r for r in got if r.doc_id in (2, 3, 4)]
    assert [r.doc_tokens for r in blank] == [1, 1, 1]


def test_shortest_pack_first():
    rng = np.random.default_rng(0)
    for capacity in (16, 100):
        histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, capacity + 1, 500), return_counts=True), strict=True)}
        patterns = packing.shortest_pack_first(histogram, capacity)
        placed: dict = {}
        for packs, pattern in patterns:
            assert packs > 0 and sum(n * times for n, times in pattern) <= capacity
            for n, times in pattern:
                placed[n] = placed.get(n, 0) + packs * times
        assert placed == histogram
        assert len(patterns) <= 3 * capacity
    assert packing.shortest_pack_first({}, 8) == []
    assert packing.shortest_pack_first({3: 5}, 8) == [(1, ((3, 1),)), (2, ((3, 2),))]


def test_token_output(spark, table, empty, tmp_path):
    path = str(tmp_path / "out")
    token_output.write_tokens(table, path, VOCABULARY, shard_tokens=5000)
    got = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == table.count()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got][-2:] == [None, None]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert token_output.document_ids(spark, path, 5)[0][-1] == 2
    none = str(tmp_path / "none")
    token_output.write_tokens(empty, none, VOCABULARY)
    assert token_output.read_tokens(spark, none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, [3, 40, 49408, 200_000][seed], 20_000).astype("<u4")
    if seed == 1:
        ids = np.tile(ids[:500], 40)
    lengths = np.array([0, 5, 10_000, 0, 9_995])
    shard = token_output.Shard(token_output.compress(ids, lengths))
    assert (shard.ids() == ids).all()
    at = 0
    for i, n in enumerate(lengths.tolist()):
        assert (shard.document(i) == ids[at : at + n]).all()
        at += n
    if seed == 1:
        assert len(shard.text) < len(ids) / 2
    assert len(token_output.Shard(token_output.compress(np.zeros(0, "<u4"), np.zeros(0, np.int64))).ids()) == 0


def test_encoder_equals_library():
    from cuepoint.llm._tokens import encoder

    own = encoder(VOCABULARY)
    rng = random.Random(1)
    parts = ["a", "B", " ", "'s", ".", "\n", "é", "♥", "1", "<|", "|>", "endoftext", "Σ", "\x1c", "\x85", "İ", "é", "ß", "Ä", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(30)) for _ in range(500)] + ["<|endoftext|>a <|startoftext|>", "ΟΔΟΣ. ΣΑΣ", ""]
    for text in texts:
        assert own(text) == np.array(own._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_mix(spark, table, empty):
    got = mixing.plan(table).collect()
    assert len(got) == table.count() and all(r.taken == r.size * r.copies <= 2 * r.size for r in got)
    by_source = {r.source: r.target for r in got}
    sizes: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert by_source == pytest.approx(brute.targets(sizes))
    out = mixing.mix(table)
    assert out.columns == table.columns and out.count() == sum(r.copies for r in got)
    assert mixing.plan(empty).collect() == [] and mixing.mix(empty).count() == 0
    wordless = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert [r.target for r in mixing.plan(wordless).collect()] == [0.0, 0.0]


def test_mix_totals(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 60), f"s{rng.randrange(5)}") for i in range(4000)], "doc_id bigint, text string, source string")
    totals = mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.08 for r in totals)


def test_similar(table, empty):
    got = {}
    for r in ngram_join.similar_documents(table).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    expected = brute.components(unique(table))
    for d, pair in expected.items():
        assert set(got[d]) == {pair}
    assert len(got[1]) == 2 and got[2] == [(0, 2)] and len(got[12]) == 2
    assert {c for _, c in got[None]} == {None}
    assert ngram_join.similar_documents(empty).collect() == []
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 7 not in ids and 8 not in ids and 9 in ids and ids.count(12) == 2  # only A to Z are lower-cased
    assert ngram_join.keep_one(empty).count() == 0


def test_large_group_of_near_copies(spark):
    """More copies than a small tile holds: a star around the first, and others that link to nothing."""
    base = prose(7, 200, 1000).split(" ")
    docs = [(0, " ".join(base))]
    rng = random.Random(3)
    for i in range(1, 90):
        words = list(base)
        for k in rng.sample(range(200), 3 if i % 3 else 9):
            words[k] = f"x{i}y{k}"
        docs.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute.components(docs)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 40), dtype=np.uint64)]))
        if not len(y):
            continue
        a, b = ngram_join._bitmap(x)[None, :], ngram_join._bitmap(y)[None, :]
        width = min(a.shape[1], b.shape[1])
        distance = int(np.bitwise_count(ngram_join._folded(a, width) ^ ngram_join._folded(b, width)).sum())
        shared = len(np.intersect1d(x, y))
        assert distance <= len(x) + len(y) - 2 * shared
        assert ngram_join._links(x, y) == (100 * shared >= 80 * (len(x) + len(y) - shared))


def test_topk(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(0, 700)]
    vectors += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] + [0.0] * 5), (1200, vectors[50][1]), (1201, vectors[50][1])]
    schema = "vec_id bigint, embedding array<float>, score string, rank int"
    table = spark.createDataFrame([(*v, "s", 1) for v in vectors] + [(None, [1.0] * 6, "s", 1)], schema)
    stored = [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in table.collect() if r.vec_id is not None]
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0).collect()))
    assert got == sorted(brute.top(stored))
    assert topk.top_k(table.filter("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert len(topk.top_k(table.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()) == 2
    short = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.5]), (2, [])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(short, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 32768), (2, 0)]


def test_topk_large_values():
    q = np.array([[1 << 40, -(1 << 20)]])
    blocks = [(np.array([1, 2]), np.array([[1 << 20, 5], [3, 1 << 30]]))]
    row, found, score = topk.search_blocks((np.array([9]), q), blocks, 2)
    assert list(zip(found.tolist(), score.tolist(), strict=True)) == [(1, (1 << 60) - 5 * (1 << 20)), (2, 3 * (1 << 40) - (1 << 50))]


PRIVATE = [
    "a@b.co.uk, x_y%z+1@d-e.f then _d@e.f9 and a@b.c_d@e.f g@h", "1.2.3.4 256.1.1.1 001.002.003.255 1.2.3.4.5.6.7.8 9.9.9.99999999999999999999 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 411111111111111 1234567890123456 0" + "0" * 13 + " " + "7" * 25, "+1 (555) 123-4567 ++44 20 7946 0958 +1 +12 (34 +123456789012345678 +49 30 123456. +1 555 123 4567 8",
    "é😀 a@b.co 😀 10.0.0.1", "+4111 1111 1111 11 a@1.2.3.4", "." * 500 + "a" * 50_000 + "@", "1 " * 20_000, "1" * 60_000, "+1" + " " * 20_000 + "5551234567", None, "", "@.@..", "%" * 3000 + "@a.b",
]


def test_pii_base(spark, empty):
    table = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id bigint, text string")
    for r in pii.digest(pii.find(table)).collect():
        *counts, digest, listed = brute.private(PRIVATE[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == [*counts, digest], r.doc_id
        assert not listed or set(listed.split(",")) <= set(r.spans.split(","))
    assert pii.find(empty).collect() == []


def test_pii_learns(spark):
    texts = [f"call me by phone +1 (55{i % 10}) 12{i % 10}-4567 or mail u{i}@site.com" for i in range(60)]
    texts += ["my phone is (415) 555-2671 thanks", "write a mail to jane.doe [at] site [dot] com today", "part 415-155-26710 of (015) 155-2671", "nothing at all here"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    spans = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in found.collect()}
    assert spans[60] == [("phone", "(415) 555-2671")]
    assert spans[61] == [("email", "jane.doe [at] site [dot] com")]
    assert spans[62] == [] and spans[63] == []


def test_pii_mask(spark, table, empty):
    out = pii.mask(table, size_col="n_chars")
    assert out.columns == table.columns and out.count() == table.count()
    got = {r.doc_id: r for r in out.filter("doc_id = 13").collect()}[13]
    assert got.text == "mail [EMAIL] [IP] [PHONE] and [CARD]" and got.n_chars == len(got.text)
    assert out.filter("doc_id = 2").first().text is None
    assert pii.mask(empty).count() == 0
    overlap = pii.mask(spark.createDataFrame([("x a@1.2.3.4 y",)], "text string")).first()
    assert overlap.text == "x [EMAIL] y"


def test_secret_layers():
    secret = 'password = "hunter2hunter2"'
    quoted = urllib.parse.quote(secret)
    packed = base64.b64encode(gzip.compress(secret.encode())).decode()
    nested = base64.b64encode(base64.b64encode(secret.encode())).decode()
    unicode = "".join(f"\\u{ord(c):04x}" for c in secret)
    for inner in (quoted, packed, nested, unicode, urllib.parse.quote(packed), base64.b64encode(unicode.encode()).decode()):
        text = f"see {inner} end"
        base, every = secrets.scan(text)
        assert not any(k == "assign" for k, _, _ in base)
        own = [(s, e) for k, s, e in every if k == "assign"]
        assert own and all(text.index(inner) <= start < end <= text.index(inner) + len(inner) for start, end in own)
    text = "é token%3Dabcdefgh x"
    assert [(k, text[s:e]) for k, s, e in secrets.scan(text)[1]] == [("assign", "token%3Dabcdefgh")]
    for cycle in ("%2525252541", "%", "\\u", "&#;", "a" * 5000, "QUFB" * 2000, "&#x110000;"):
        secrets.scan(cycle)


SECRETS = ["secret=token: abcdefgh", "TOKEN: 'abc_DEF.1' api-key=x apikey=123456", "AKIA" + "A" * 16 + " AKIAAKIA AKIA" + "B" * 15, "0123456789abcdef01234567 " + "f" * 23, "paſſword=abcdefgh toKen=abcdefg", None, "", "passwd:='abcdef", "password = \"a'b"]


def test_secrets_base(spark, table, empty):
    frame = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id bigint, text string")
    for r in secrets.digest(secrets.find(frame)).collect():
        *counts, digest, listed = brute.secret(SECRETS[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == [*counts, digest], r.doc_id
        assert not listed or set(listed.split(",")) <= set(r.spans.split(","))
    assert secrets.find(table).count() == table.count() and secrets.find(empty).collect() == []


def test_sentences(spark, table, empty):
    docs = unique(table) + [(20, "Intro words. " + " ".join(f"Repeated sentence number {i} with words." for i in range(9)) + " Outro."), (21, "Other. " + " ".join(f"Repeated sentence number {i} with words." for i in range(9)) + " The end of it.")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in sentence_dedup.remove_repeats(frame).collect()}
    assert got == brute.sentence_repeats(docs, sentence_dedup.MIN_SENTENCES, sentence_dedup.MIN_WORDS, sentence_dedup.LONG_SENTENCE)
    assert got[20][2] == 0 and got[21][0] == "Other. The end of it."
    out = sentence_dedup.remove_repeats(table)
    assert [c for c in out.columns if c in table.columns] == [c for c in table.columns if c != "n_sentences"] and out.count() == table.count()
    assert sentence_dedup.remove_repeats(empty).count() == 0
    assert sentence_dedup.remove_repeats(frame.select("doc_id", "text")).count() == len(docs)


def test_quality(spark, table, empty):
    got = quality.verdicts(table).collect()
    assert len(got) == table.count()
    texts = dict(unique(table))
    for r in got:
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[r.doc_id])
    kept = quality.filter_documents(table)
    assert kept.columns == table.columns and kept.count() == sum(r.kept for r in got)
    assert quality.verdicts(empty).collect() == [] and quality.filter_documents(empty).count() == 0


def test_quality_adapts(spark):
    plain = [(i, prose(i, 80), "en", "a") for i in range(300)]
    marked = [(1000 + i, " | ".join(prose(i, 80).split(" ")), "en", "tables") for i in range(300)]
    stray = [(5000, " | ".join(prose(9, 80).split(" ")), "en", "a")]
    kept = {r.doc_id for r in quality.verdicts(spark.createDataFrame(plain + marked + stray, "doc_id bigint, text string, lang string, source string")).filter("kept").collect()}
    assert kept == {i for i, *_ in plain + marked}


def test_suffixes(spark, table, empty):
    docs = unique(table)
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = letters(130)
    docs += [(30, letters(80) + shared + letters(90)), (31, shared), (32, letters(10) + shared[:99]), (33, shared[20:125] + letters(40) + shared), (34, "ab" * 300), (35, "z" * 99), (36, "z" * 100), (37, "z" * 101)]
    docs += [(40 + i, letters(60) + shared[i : i + 104] + letters(60)) for i in range(20)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"))).collect()}
    assert got == brute.repeats(docs)
    assert suffix_dedup.remove_repeats(table).count() == table.count()
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_suffix_mergesort():
    from cuepoint.llm import _text as T

    rng = np.random.default_rng(8)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2400] = data[:400]
    start = rng.integers(0, len(data) - suffix_dedup.SIZE, 500)
    start[250:] = np.concatenate([start[:125], start[:125] % 300 + 2000])
    segment = np.sort(rng.integers(0, 20, 500))
    prefix = T.prefix_hashes(data)
    whole = T.span_hashes(prefix, start, start + suffix_dedup.SIZE)
    order = suffix_dedup.suffix_mergesort(data, prefix, whole, start, segment)
    expected = sorted(range(500), key=lambda i: (segment[i], data[start[i] : start[i] + suffix_dedup.SIZE].tobytes(), i))
    assert order.tolist() == expected
