"""Alignment of two tokenizers' tokens, relational.

Tokens of both are exploded with their places, running sums of their byte lengths in a window give their
ends, and an equi-join on the end finds where tokens of both end together. A running count of these cuts
numbers the groups; the joined rows are the links, and their counts by id pair, over all documents, are
joined back to them.

The key beside the end is not the document but a piece of text. Texts are cut where both tokenizers always
cut, whatever is around: before a space that follows a character which is no white space and no control
character, between letters and marks, and around a single line break. A's pattern never matches across
these places; that B has no token across them is seen from its vocabulary. Equal pieces are exploded and
aligned once, with the number of their occurrences as weight, so the relational work grows with the
different pieces. A slice of the documents keeps its texts as codes of its words, and its words as codes of
pieces, and gets the aligned pieces back to put its documents' groups together.

Cases: null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no
tokens and take no part in the counts; repeated rows count as often as they come and get a row each; an
empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import dropped, written
from ._tokens import _byte_letters

#: Words that a slice's list holds, and codes of its texts, at most (about).
SLICE_WORDS, SLICE_CODES = 1 << 19, 1 << 23
#: Pieces that are encoded at a time.
ENCODED_PIECES = 2048

_SPACE = "\u2581"
#: White space, and what might count as such, behind which a space does not begin a piece.
_ODD = r"[\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"
_JOINED = re.compile(f"(?:^|{_ODD}) ")
_ODD_END = re.compile(f"(?:^|{_ODD})\\Z")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Marks that a letter may be cut from; an apostrophe may belong to letters.
_MARKS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]
_loaded: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers: byte-level A on " " + text, B, which adds the space itself, on the text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {v: k for k, v in _byte_letters().items()}
        self.bytes_a: dict[int, bytes] = {}
        for token, i in self.a.get_vocab().items():
            try:
                self.bytes_a[i] = bytes(letters.get(ord(c), ord(c)) for c in token)
            except ValueError:  # not in byte letters, as special tokens may be
                self.bytes_a[i] = token.encode()
        whole = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = whole.fullmatch(piece)
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte and self.b.is_byte(i) else piece.replace(_SPACE, " ").encode())
        self.space = self.b.piece_to_id(_SPACE)
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Where a word, with the space before it, is cut further: B has no token with the two characters side by side."""
        texts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        beside = {x for t in texts for x in zip(t, t[1:])}
        if any("\n" in x for x in beside):
            return re.compile("(?!)")
        letter = re.compile(f"[{_LETTERS}]")
        apart = lambda m: not any(m in x and (letter.match(x[0]) or letter.match(x[1])) for x in beside)
        marks = "".join(map(re.escape, filter(apart, _MARKS)))
        found = [f"(?<=[{_LETTERS}])(?=[{marks}])", f"(?<=[{marks}])(?=[{_LETTERS}])"] if marks else []
        found += [f"(?<=[{_LETTERS}{marks}])(?=\n[{_LETTERS}{marks}])", f"(?<=[{_LETTERS}{marks}]\n)(?=[{_LETTERS}{marks}])"]
        return re.compile("|".join(found))

    def returns(self, text: str) -> bool:
        """Whether B gives back the text as it is; A always does."""
        return self.b.normalize(text) == _SPACE + text.replace(" ", _SPACE) and _SPACE not in text

    def encode(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
        """Ids and byte lengths of pieces by A and B."""
        by_a = self.a.encode_batch_fast(pieces, add_special_tokens=False)
        # B adds a space; where a piece has none, a line break, which no token of B joins, keeps the two apart
        by_b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        for piece, found, b in zip(pieces, by_a, by_b, strict=True):
            a, b = found.ids, [self.space] if piece == " " else b if piece[0] == " " else b[2:]
            parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            if not piece.encode() == b"".join(parts_a) == b"".join(parts_b):
                raise ValueError(f"a tokenizer changes the piece {piece[:80]!r}, though not as part of a text")
            yield a, list(map(len, parts_a)), b, list(map(len, parts_b))


def pair(path_a: str, path_b: str) -> Pair:
    """The worker's tokenizers, loaded once."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


def words(text: str) -> list[str]:
    """" " + text cut before spaces; each word without the space that it begins with."""
    parts = text.split(" ")
    if not _JOINED.search(text):
        return parts
    out = [[parts[0]]]
    for before, part in zip(parts, parts[1:]):
        if _ODD_END.search(before):
            out[-1].append(part)
        else:
            out.append([part])
    return [" ".join(x) for x in out]


_CODED = {"slice": pa.int64(), "doc_id": pa.int64(), "codes": pa.binary(), "ends": pa.binary(), "code": pa.int32(), "piece": pa.string(), "n": pa.int64()}


def _coded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of three kinds: documents as packed codes of words and the bytes that they unpack to, each slice's
    words as codes of pieces (with ``ends``), and each slice's pieces (``code``) with their occurrences."""

    def rows(size: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * size), k) for c, k in _CODED.items()], list(_CODED))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        both = pair(path_a, path_b)
        known: dict[str, int] = {}
        docs: list[tuple[int | None, bytes]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = (part << 32) + made
            counts = np.zeros(len(known), np.int64)
            for at in range(0, len(docs), 1024):
                own = docs[at : at + 1024]
                counts += np.bincount(np.frombuffer(b"".join(c for _, c in own), np.uint32), minlength=len(known))
                # early, and so frequent, words have small codes, which pack well
                yield rows(len(own), slice=[name] * len(own), doc_id=[d for d, _ in own], codes=[pa.compress(c, "zstd", asbytes=True) for _, c in own], n=[len(c) for _, c in own])
            names: dict[str, int] = {}
            codes, ends = array("I"), array("I")
            for word in known:
                codes.extend([names.setdefault(p, len(names)) for p in both.cut.split(f" {word}")])
                ends.append(len(codes))
            yield rows(1, slice=[name], codes=[codes.tobytes()], ends=[ends.tobytes()])
            occurs = np.repeat(counts, np.diff(np.frombuffer(ends, np.uint32), prepend=np.uint32(0))) if known else counts
            n = np.zeros(len(names), np.int64)
            np.add.at(n, np.frombuffer(codes, np.uint32), occurs)
            pieces = list(names)
            for at in range(0, len(pieces), 8192):
                to = min(at + 8192, len(pieces))
                yield rows(to - at, slice=[name] * (to - at), code=list(range(at, to)), piece=pieces[at:to], n=n[at:to].tolist())

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if not text or not both.returns(text):
                    docs.append((doc, b""))
                else:
                    found = words(text)
                    codes = list(map(known.get, found))
                    at = -1
                    try:
                        while True:
                            at = codes.index(None, at + 1)
                            codes[at] = known.setdefault(found[at], len(known))
                    except ValueError:
                        docs.append((doc, array("I", codes).tobytes()))
                    held += len(codes)
                if len(known) >= SLICE_WORDS or held >= SLICE_CODES or len(docs) >= 1 << 16:
                    yield from flush()
                    made, held = made + 1, 0
                    known.clear()
                    docs.clear()
        if docs:
            yield from flush()

    return docs.mapInArrow(code, "slice bigint, doc_id bigint, codes binary, ends binary, code int, piece string, n bigint")


def _encoded(distinct: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(piece_id, piece, n)`` with arrays of ``(id, size)`` by both tokenizers."""
    token = pa.list_(pa.struct([("id", pa.int32()), ("size", pa.int32())]))

    def tokens(ids: list[list[int]], sizes: list[list[int]]) -> pa.Array:
        edges = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
        flat = [pa.array([v for x in xs for v in x], pa.int32()) for xs in (ids, sizes)]
        return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(flat, ["id", "size"])).cast(token)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for whole in batches:
            for at in range(0, len(whole), ENCODED_PIECES):
                batch = whole.slice(at, ENCODED_PIECES)
                a, a_size, b, b_size = zip(*both.encode(batch.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, tokens(a, a_size), tokens(b, b_size)], ["piece_id", "piece", "n", "a", "b"])

    kind = "array<struct<id:int,size:int>>"
    return distinct.mapInArrow(encode, f"piece_id bigint, piece string, n bigint, a {kind}, b {kind}")


def _ends(encoded: DataFrame, side: str) -> DataFrame:
    """A row for each token: ``(piece_id, end, <side>)`` with the byte offset of its end in the piece."""
    upto = Window.partitionBy("piece_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    exploded = encoded.select("piece_id", F.posexplode(side).alias("pos", "token"))
    return exploded.select("piece_id", F.sum("token.size").over(upto).alias("end"), F.col("token.id").alias(side))


def aligned_tokens(encoded: DataFrame) -> DataFrame:
    """A row for each byte offset at which a token of A, B or both ends, with the number of its group."""
    before = Window.partitionBy("piece_id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    # explode and window keep this partitioning, so tokens are shuffled for the join alone
    dealt = encoded.select("piece_id", "a", "b").repartition("piece_id")
    both = _ends(dealt, "a").join(_ends(dealt, "b"), ["piece_id", "end"], "full")
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.withColumn("cut", cut).withColumn("group", F.coalesce(F.sum(F.col("cut").cast("int")).over(before), F.lit(0)))


def pair_counts(links: DataFrame, weights: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: occurrences of each linked pair of ids, and whether no pair with its B id has more."""
    counts = links.join(weights, "piece_id").groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = written(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    best = written(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "best-pairs")
    dropped(counts)
    return best


def _summed(encoded: DataFrame) -> DataFrame:
    """A row for each piece: what it adds to its documents' counts, and its groups as text."""
    rows = written(aligned_tokens(encoded), "aligned-tokens", compression="zstd")
    links = rows.filter("cut").select("piece_id", "a", "b")
    counts = pair_counts(links, encoded.select("piece_id", "n"))
    ids = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side)))), lambda x: x[side].cast("string")), ",")
    groups = rows.repartition("piece_id").groupBy("piece_id", "group").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.concat(ids("a"), F.lit("|"), ids("b")).alias("listed"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("group", "listed"))), lambda x: x["listed"])
    per = groups.groupBy("piece_id").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.array_join(in_order, ";").alias("listed"))
    scored = links.join(counts, ["a", "b"]).groupBy("piece_id").agg(F.count("*").alias("n_links"), F.count(F.when(F.col("best"), 1)).alias("n_best"), F.sum("count").alias("count_sum"))
    summed = written(encoded.select("piece_id", "piece").join(per.join(scored, "piece_id"), "piece_id").drop("piece_id"), "aligned-pieces", compression="zstd")
    dropped(encoded, rows, counts)
    return summed


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _assembled(coded: DataFrame, aligned: DataFrame, with_groups: bool) -> DataFrame:
    """Each document's sums and groups from its pieces'."""
    texts = coded.filter("codes is not null").select("slice", "doc_id", "codes", "ends", "n")
    kinds = [pa.int64()] * 7 + [pa.string()] * (1 + with_groups)
    names = ["doc_id", *_SUMS, "groups_sha256", *["groups"] * with_groups]

    def assemble(texts: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(own.column("code").to_numpy())
        sums = [own.column(c).to_numpy()[order] for c in _SUMS]
        listed = own.column("listed").take(pa.array(order)).to_pylist()
        docs = texts.filter(pc.is_null(texts.column("ends")))
        (of_words,) = texts.filter(pc.is_valid(texts.column("ends"))).select(["codes", "ends"]).to_pylist()
        parts, ends = np.frombuffer(of_words["codes"], np.uint32), np.frombuffer(of_words["ends"], np.uint32).astype(np.int64)
        starts = np.append(0, ends[:-1])[: len(ends)]
        sums = [np.add.reduceat(x[parts], starts) if len(starts) else x for x in sums]
        codes = parts.tolist()
        listed = [listed[codes[a]] if b - a == 1 else ";".join([listed[c] for c in codes[a:b]]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out: list[list] = [[] for _ in names]
        for doc, packed, size in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "codes", "n")), strict=True):
            codes = np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.uint32) if size else np.zeros(0, np.uint32)
            groups = ";".join(map(listed.__getitem__, codes.tolist()))
            row = [doc, *(int(x[codes].sum()) for x in sums), hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups]
            for column, x in zip(out, row):
                column.append(x)
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    schema = ", ".join(f"{c} {'bigint' if k == pa.int64() else 'string'}" for c, k in zip(names, kinds, strict=True))
    return texts.groupBy("slice").cogroup(aligned.withColumnRenamed("slice", "of").groupBy("of")).applyInArrow(assemble, schema)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """A row for each document: tokens of A and B, groups, links, links that are their B id's most frequent,
    the sum of the links' counts, and a hash of the groups; ``groups`` itself on request."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    coded = written(_coded(plain, path_a, path_b), "coded-texts", compression="zstd")
    lists = coded.filter("code is not null").select("slice", "code", "piece", "n")
    distinct = lists.groupBy("piece").agg(F.sum("n").alias("n"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("piece_id"), "piece", "n")
    encoded = written(_encoded(distinct, path_a, path_b), "encoded-pieces", compression="zstd")
    summed = _summed(encoded)
    aligned = written(lists.drop("n").join(summed, "piece").drop("piece"), "aligned-lists", compression="zstd")
    dropped(summed)
    return _assembled(coded, aligned, with_groups)
