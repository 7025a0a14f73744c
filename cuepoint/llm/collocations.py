"""Phrase collocations from position bitmaps of words.

Documents of a language are cut into shards. In a shard every word has a bitmap of the places where it
comes, compressed to its bytes that aren't zero; an empty place between pieces keeps phrases within them.
A phrase is extended by shifting its bitmap by one place and taking the AND with the bitmaps of words
that share a byte with it; popcounts are its occurrences, and all extensions of a batch of prefixes are
made before the next batch. Popcounts are summed over shards by buckets of phrases. Each bucket answers a
shard's part with a bit for every phrase that is frequent in all shards together; the next length starts
from those alone, and only if the new phrase without its first word is frequent too.

Words are named by 64-bit hashes of language and word. Where two words share one, which the table of
words shows, all is done again with other hashes.

Cases: null texts are empty, a null language is ``und``; repeated rows count as often as they come; a
language without candidates has no rows and an empty table gives none; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _terms
from . import _text as T
from ._scratch import written

MAX_WORDS, MIN_COUNT, TOP, COVERED = 3, 10, 2000, 50
#: Bytes of words in a shard, and those that a task holds for all languages, about.
SHARD_BYTES, HELD_BYTES = 8 << 20, 16 << 20
#: Words of all documents for each bucket of phrases, and its phrases that are sorted at a time, about.
BUCKET_WORDS, SORTED = 2_000_000, 1 << 17
#: Bytes of bitmaps that are extended at a time, and pairs of bytes that are met at a time.
BATCH, PAIRS = 1 << 18, 1 << 20
NO_LANGUAGE = "und"

_BORDER = (1 << 32) - 1
_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_INSIDE = ~(_BREAK | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8)))
_SHARD = "shard bigint, lang string, terms binary, term_ends binary, codes binary"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, the text of each, and whether it is its piece's first."""
    low = T.lowered(data)
    inside = _INSIDE[low]
    starts, ends, text = _terms.runs(inside, offsets)
    breaks = np.append(0, np.cumsum(_BREAK[low]))[starts]
    first = np.append(True, (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1]))[: len(starts)]
    return _terms.packed(low[inside], np.cumsum(ends - starts)), text, first


def _shard(name: int, lang: str, words: list[pa.Array], first: list[np.ndarray]) -> pa.RecordBatch:
    codes, terms = _terms.coded(words)
    heads = np.flatnonzero(np.concatenate(first))
    data, ends = _terms.unpacked(terms)
    values = [name, lang, data, ends.astype("<u4").tobytes(), np.insert(codes.astype("<u4"), heads, _BORDER).tobytes()]
    kinds = [pa.int64(), pa.string(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], ["shard", "lang", "terms", "term_ends", "codes"])


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Words of the documents as codes, by language and shard, written to the shared folder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, tuple[list, list, list]] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, first, _ = held.pop(lang)
            made += 1
            return _shard((part << 32) + made, lang, words, first)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for row, data, offsets in T.slices(batch.column(1)):
                found, text, first = _words(data, offsets)
                lang = of[row + text]
                for k in np.unique(lang).tolist():
                    own = lang == k
                    words, heads, size = held.setdefault(names[k], ([], [], []))
                    words.append(found.filter(pa.array(own)))
                    heads.append(first[own])
                    size.append(int(words[-1].nbytes))
                    if sum(size) >= shard_bytes:
                        yield flush(names[k])
                while sum(sum(x[2]) for x in held.values()) > HELD_BYTES:
                    yield flush(max(held, key=lambda x: sum(held[x][2])))
        for lang in list(held):
            yield flush(lang)

    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    return written(plain.mapInArrow(cut, _SHARD), "word-shards", compression="zstd")


def _keys(lang: str, terms: bytes, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of a language's words."""
    name = np.frombuffer(lang.encode() + b"\0", np.uint8)
    salt = T.mix(T.run_hashes(name, np.array([0]), np.array([len(name)])) + np.uint64(seed))
    ends = ends.astype(np.int64)
    return T.mix(T.run_hashes(np.frombuffer(terms, np.uint8), np.append(0, ends[:-1])[: len(ends)], ends) ^ salt)


def word_counts(cut: DataFrame, seed: int) -> DataFrame:
    """``(key, lang, word, a)``: occurrences of every word of a language, and the name that it goes by."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                ends = np.frombuffer(row["term_ends"], "<u4")
                codes = np.frombuffer(row["codes"], "<u4")
                n = np.bincount(codes[codes != _BORDER], minlength=len(ends))
                words = _terms.packed(row["terms"], ends).cast(pa.string())
                keys = _keys(row["lang"], row["terms"], ends, seed).view(np.int64)
                for at in range(0, len(ends), 8192):
                    own = slice(at, at + 8192)
                    size = len(n[own])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array([row["lang"]] * size, pa.string()), words[own], pa.array(n[own], pa.int64())], ["key", "lang", "word", "a"])

    return cut.mapInArrow(count, "key bigint, lang string, word string, a bigint").groupBy("key", "lang", "word").agg(F.sum("a").alias("a"))


class Bitmaps:
    """Bitmaps of a shard's words: for each word its bytes of eight places that aren't empty."""

    def __init__(self, codes: np.ndarray, words: int):
        full = np.full(-(-len(codes) // 8) * 8, _BORDER, np.int64)
        full[: len(codes)] = codes
        rows = full.reshape(-1, 8)
        place = np.argsort(rows, axis=1, kind="stable")
        code = np.take_along_axis(rows, place, 1).ravel()
        head = np.append(True, code[1:] != code[:-1])
        head[::8] = True
        at = np.flatnonzero(head)
        mask = np.bitwise_or.reduceat((1 << place).astype(np.uint8).ravel(), at) if len(at) else np.zeros(0, np.uint8)
        real = code[at] != _BORDER
        #: bytes of all words by block
        self.block, self.code, self.mask = (at >> 3)[real], code[at][real], mask[real]
        self.words = words
        self.begin = np.searchsorted(self.block, np.arange(len(rows) + 2))

    def single(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' bitmaps, word by word: ``(word, block, byte)``."""
        order = np.argsort(self.code, kind="stable")
        return self.code[order], self.block[order], self.mask[order]

    def extend(self, prefix: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of prefixes shifted by one place, AND every word's: ``(prefix * words + word, block, byte)``."""
        carried = np.flatnonzero(mask & 128)
        prefix = np.concatenate([prefix, prefix[carried]])
        shifted = np.concatenate([mask << 1, np.ones(len(carried), np.uint8)])
        block = np.concatenate([block, block[carried] + 1])
        n = self.begin[block + 1] - self.begin[block]
        upto, out = np.cumsum(n), []
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            own = np.repeat(np.arange(at, to), n[at:to])
            other = np.arange(len(own)) + np.repeat(self.begin[block[at:to]] - (np.cumsum(n[at:to]) - n[at:to]), n[at:to])
            both = shifted[own] & self.mask[other]
            some = np.flatnonzero(both)
            own, other = own[some], other[some]
            out.append((prefix[own] * self.words + self.code[other], block[own], both[some]))
            at = to
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (prefix, block, mask)


class Phrases:
    """A shard's phrases of one length: numbers of their prefix and last word in one, ascending, where
    each one's words are, their places, and the number of each without its first word a length below."""

    def __init__(self, codes: np.ndarray, rests: np.ndarray, counts: np.ndarray, bitmaps: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray):
        self.codes, self.rests, self.counts, self.bitmaps, self.keys = codes, rests, counts, bitmaps, keys

    @classmethod
    def single(cls, maps: Bitmaps) -> "Phrases":
        every = np.arange(maps.words)
        return cls(every[:, None], np.zeros(maps.words, np.int64), np.zeros(0), maps.single(), every)

    def longer(self, maps: Bitmaps, below: "Phrases | None") -> "Phrases":
        """All phrases with one word more; ``below`` has phrases as long as these, in which what follows
        the first word must be found."""
        phrase, block, mask = self.bitmaps
        keys, counts, bitmaps = [], [], []
        at, known = 0, 0
        while at < len(phrase):
            # a batch ends with a prefix
            to = int(np.searchsorted(phrase, phrase[min(at + BATCH, len(phrase)) - 1], "right"))
            key, own, byte = maps.extend(phrase[at:to], block[at:to], mask[at:to])
            if below is not None:
                prefix, word = np.divmod(key, maps.words)
                rest = self.rests[prefix] * maps.words + word
                near = np.minimum(np.searchsorted(below.keys, rest), max(len(below.keys) - 1, 0))
                found = np.flatnonzero(below.keys[near] == rest) if len(below.keys) else np.zeros(0, np.int64)
                key, own, byte = key[found], own[found], byte[found]
            order = np.argsort(key, kind="stable")
            key, own, byte = key[order], own[order], byte[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            if len(heads):
                counts.append(np.add.reduceat(np.bitwise_count(byte).astype(np.int64), heads))
                keys.append(key[heads])
                bitmaps.append((np.repeat(np.arange(len(heads)) + known, np.diff(np.append(heads, len(key)))), own, byte))
                known += len(heads)
            at = to
        none = np.zeros(0, np.int64)
        keys_, counts_ = (np.concatenate(x) if x else none for x in (keys, counts))
        joined = tuple(map(np.concatenate, zip(*bitmaps, strict=True))) if bitmaps else (none, none, np.zeros(0, np.uint8))
        prefix, word = np.divmod(keys_, maps.words)
        rests = word if below is None else np.searchsorted(below.keys, self.rests[prefix] * maps.words + word)
        return Phrases(np.column_stack([self.codes[prefix], word]), rests, counts_, joined, keys_)

    def only(self, kept: np.ndarray) -> "Phrases":
        """Those with a set flag, numbered anew."""
        number = np.cumsum(kept) - 1
        phrase, block, mask = self.bitmaps
        own = np.flatnonzero(kept[phrase])
        return Phrases(self.codes[kept], self.rests[kept], self.counts[kept], (number[phrase[own]], block[own], mask[own]), self.keys[kept])


def _dealt(phrases: Phrases, names: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each bucket's phrases of a shard: their numbers, and their words' hashes."""
    if not len(phrases.codes):
        return
    rows = names[phrases.codes]
    mixed = _mixed(rows)
    bucket = ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:b], rows[order[a:b]]


def _mixed(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = T.mix(out * np.uint64(3) + rows[:, k])
    return out


def _counted(cut: DataFrame, replies: list[DataFrame], size: int, buckets: int, seed: int) -> DataFrame:
    """``(bucket, shard, size, rows, counts)``: shards' phrases of ``size`` words, dealt to buckets.

    ``replies`` holds, for each shorter length from two words on, the bits that say which phrases go on."""
    schema = "bucket int, shard bigint, size int, rows binary, counts binary"

    def walk(row: dict, bits: dict[tuple[int, int], bytes]) -> Iterator[tuple]:
        names = _keys(row["lang"], row["terms"], np.frombuffer(row["term_ends"], "<u4"), seed)
        maps = Bitmaps(np.frombuffer(row["codes"], "<u4"), len(names))
        now, below = Phrases.single(maps), None
        for length in range(2, size + 1):
            longer = now.longer(maps, below)
            if length == size:
                for bucket, at, rows in _dealt(longer, names, buckets):
                    yield bucket, row["shard"], size, rows.astype("<u8").tobytes(), longer.counts[at].astype("<u4").tobytes()
                return
            kept = np.zeros(len(longer.keys), bool)
            for bucket, at, _ in _dealt(longer, names, buckets):
                kept[at] = np.unpackbits(np.frombuffer(bits[length, bucket], np.uint8), count=len(at)).astype(bool)
            now = below = longer.only(kept)

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names_ = ["bucket", "shard", "size", "rows", "counts"]

    def table(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]

    if not replies:

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    for part in walk(batch.slice(i, 1).to_pylist()[0], {}):
                        yield pa.RecordBatch.from_arrays(table([part]), names_)

        return cut.mapInArrow(plain, schema)

    def answered(own: pa.Table, bits: pa.Table) -> pa.Table:
        known = {(r["size"], r["bucket"]): r["bits"] for r in bits.to_pylist()}
        return pa.table(table([x for row in own.to_pylist() for x in walk(row, known)]), names=names_)

    sent = replies[0]
    for other in replies[1:]:
        sent = sent.unionByName(other)
    return cut.groupBy("shard").cogroup(sent.withColumnRenamed("shard", "of").groupBy("of")).applyInArrow(answered, schema)


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all values of a binary column, not copied, and how many are in each."""
    values = column.combine_chunks()
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
    size = np.dtype(kind).itemsize
    return np.frombuffer(values.buffers()[2], kind, int(ends[-1] - ends[0]) // size, int(ends[0])), np.diff(ends) // size


def _added(group: pa.Table, least: int) -> pa.Table:
    """A bucket's frequent phrases, and the bits that answer each shard's part. Its phrases are sorted in ranges of their
    mixed values, so little is held beside them."""
    size, bucket = group.column("size")[0].as_py(), group.column("bucket")[0].as_py()
    every, (counts, lengths) = _flat(group.column("rows"), "<u8")[0].reshape(-1, size), _flat(group.column("counts"), "<u4")
    mixed = _mixed(every)
    ranges = max(1, len(mixed) // SORTED)
    part = ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16)
    where, ends = np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=ranges))
    flags = np.zeros(len(mixed), bool)
    keys, totals = [np.zeros((0, size), np.uint64)], [np.zeros(0, np.int64)]
    for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        if a == b:
            continue
        own = where[a:b]
        order = own[np.argsort(mixed[own], kind="stable")]
        rows = every[order]
        differ = (rows[1:] != rows[:-1]).any(axis=1)
        if (differ & (mixed[order[1:]] == mixed[order[:-1]])).any():  # two phrases of one mixed value lie side by side
            again = np.lexsort(rows.T[::-1])
            order, rows = order[again], rows[again]
            differ = (rows[1:] != rows[:-1]).any(axis=1)
        head = np.append(True, differ)
        heads = np.flatnonzero(head)
        total = np.add.reduceat(counts[order].astype(np.int64), heads)
        frequent = total >= least
        flags[order] = frequent[np.cumsum(head) - 1]
        keys.append(rows[heads[frequent]])
        totals.append(total[frequent])
    bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(lengths)[:-1])]
    found, total = np.concatenate(keys).view(np.int64), np.concatenate(totals)
    n, m = len(bits), len(found)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * size, pa.int32()), pa.array(found.ravel()))
    return pa.table(
        {
            "shard": pa.concat_arrays([group.column("shard").combine_chunks().cast(pa.int64()), pa.nulls(m, pa.int64())]),
            "bucket": pa.array(np.full(n + m, bucket), pa.int32()),
            "size": pa.array(np.full(n + m, size), pa.int32()),
            "bits": pa.concat_arrays([pa.array(bits, pa.binary()), pa.nulls(m, pa.binary())]),
            "keys": pa.concat_arrays([pa.nulls(n, lists.type), lists]),
            "a": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(total)]),
        }
    )


def _summed(parts: DataFrame, least: int) -> DataFrame:
    """Frequent phrases ``(keys, a)``, and the bits that answer each shard's part ``(shard, bucket, size, bits)``."""
    schema = "shard bigint, bucket int, size int, bits binary, keys array<bigint>, a bigint"
    return parts.groupBy("bucket").applyInArrow(lambda group: _added(group, least), schema)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """All words ``(key, lang, word, a)`` and all frequent phrases ``(keys, a)`` of two words or more."""
    cut = shards(docs, text_col, lang_col)
    seed = 0
    words = written(word_counts(cut, seed), "word-counts")
    while not words.groupBy("key").count().filter("count > 1").isEmpty():
        seed += 1
        words = written(word_counts(cut, seed), "word-counts")
    buckets = max(1, -(-int(words.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]) // BUCKET_WORDS))
    replies: list[DataFrame] = []
    phrases: DataFrame | None = None
    for size in range(2, max_words + 1):
        level = written(_summed(_counted(cut, replies, size, buckets, seed), least), f"phrases-{size}")
        replies.append(level.filter("bits is not null").select("shard", "bucket", "size", "bits"))
        own = level.filter("keys is not null").select("keys", "a")
        phrases = own if phrases is None else phrases.unionByName(own)
    return words, phrases


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact for counts up to 10**16."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Each language's best phrases: ``(lang, rank, phrase, a, l, r, n, score)``."""
    words, phrases = frequent_phrases(docs, text_col, lang_col, max_words, least)
    named = words.filter(F.col("a") >= least).select("key", "lang", "word", "a")
    parts = named.select(F.array("key").alias("keys"), "a").unionByName(phrases)
    cuts = phrases.select("keys", "a", F.explode(F.sequence(F.lit(1), F.size("keys") - 1)).alias("k"))
    cuts = cuts.select("keys", "a", "k", F.slice("keys", F.lit(1), F.col("k")).alias("head"), F.slice("keys", F.col("k") + 1, F.size("keys") - F.col("k")).alias("tail"))
    cuts = cuts.join(parts.select(F.col("keys").alias("head"), F.col("a").alias("l")), "head").join(parts.select(F.col("keys").alias("tail"), F.col("a").alias("r")), "tail")
    lowest = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("low")
    scored = cuts.groupBy("keys", "a").agg(lowest)

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("keys") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("keys") - n + 1), lambda i: F.slice("keys", i, n))))
    longer = phrases.filter(F.size("keys") > 2).select(F.explode(inner).alias("keys"), "a").groupBy("keys").agg(F.max("a").alias("within"))
    kept = scored.join(longer, "keys", "left").filter(~(100 * F.coalesce("within", F.lit(0)) >= covered * F.col("a")))

    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    placed = kept.withColumn("key", F.col("keys")[0]).join(named.select("key", "lang"), "key").select("lang", "keys", "a", F.col("low.score").alias("score"), F.col("low.l").alias("l"), F.col("low.r").alias("r"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # words are looked up only for what can be among the first
    first = placed.withColumn("rank", F.rank().over(best)).filter(F.col("rank") <= top).drop("rank")
    spelled = first.select("lang", "keys", "a", "l", "r", "score", F.posexplode("keys").alias("pos", "key")).join(named.select("key", "word"), "key")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    listed = spelled.groupBy("lang", "keys", "a", "l", "r", "score").agg(F.array_join(in_order, " ").alias("phrase")).join(totals, "lang")
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
