"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, sorted-array intersection.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``THRESHOLD`` percent. Work is done for each distinct set once; copies follow their set.

1. One pass hashes all texts to sets and counts shingles that are frequent in a slice; frequent
   shingles of the whole corpus are put last in the order of prefixes.
2. A set that links to another shares one of its first ``n - ceil(0.8 n) + 1`` shingles with it
   (prefix filter), so sets meet in tiles, one for each prefix shingle.
3. Bitmaps (parities of hashed shingles, at least two bits a shingle) bound the overlap of two sets from
   above. Small tiles give pairs of fitting sizes, which are tested one by one. Large tiles are cut into
   groups of neighbouring bands of sizes, whose bitmaps meet. Every link is within a cluster of what passed.
4. The texts of a cluster meet: sets, bitmaps, then exact intersection of sorted arrays, leaving out
   pairs that are connected already. Tasks return stars, so a group of thousands of near copies isn't
   expanded into its pairs.
5. Components of all links come from large-star/small-star rounds.

In steps 3 and 4 a group of up to ``BLOCK`` sets and ``BLOCK_BYTES`` meets in one task. A larger one is cut into blocks, and
each meets with a few pivots, which most near copies link to: their number grows with the group, not
with its square. What this leaves outside the group's largest component then meets every block.

Sets are identified by 64-bit hashes of their content; a second hash finds two sets with one
identity, and the pass is then repeated with another seed.

Cases: a text without words, or null, has the empty set and is its own component; fewer than five
words count as one shingle; a null ``doc_id`` takes part, and is a component's id only where no
member has one; repeated rows get equal results; an empty table gives no rows; other columns are
ignored by ``similar_documents`` and passed on by ``keep_one``. Rows are told apart by id and a 64-bit
hash of the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._links import components
from ._scratch import written

#: Percent of the union that two sets share at least.
THRESHOLD = 80
SHINGLE = 5
#: Frequent shingles: in at least this many documents, this share of them, and so often that no more than
#: ``FREQUENT_MOST`` can be, whatever the corpus and the length of its texts: 16 MB that are broadcast.
FREQUENT_COUNT, FREQUENT_SHARE, FREQUENT_MOST = 24, 0.0005, 1 << 20
#: Prefix shingles that one bucket's task holds, about.
BUCKET_ELEMENTS = 400_000
#: Tasks that buckets are dealt to at most.
BUCKET_TASKS = 16_384
#: Tiles of up to this many sets give pairs; sets of a block; pivots of a group of several blocks, about, and
#: at least, where so many are more than a block's bytes.
SMALL_TILE, BLOCK, PIVOTS, LEAST_PIVOTS = 24, 1024, 16, 4
#: Bytes of a block, about: texts and sets, or bitmaps.
BLOCK_BYTES = 64 << 20

_ELEMENT = np.dtype([("hash", "<u8"), ("node", "<i8"), ("n", "<u4")])


def _identity(own: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed integers."""
    salt = T.mix(np.array([2 * seed + 1, 2 * seed + 2], np.uint64))
    both = np.array([T.mix(own ^ s).sum(dtype=np.uint64) for s in salt], np.uint64)
    return tuple(T.mix(both + np.uint64(len(own))).view(np.int64).tolist())


def _bitmap(own: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles in a power of two of bits, at least two for each shingle."""
    width = 1 << max(6, (2 * len(own) - 1).bit_length())
    bits = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps brought to fewer bits; parities add up, so halves are joined by exclusive or."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the sizes alone allow a link, the smaller against the larger."""
    return 100 * np.minimum(n, m).astype(np.int64) >= THRESHOLD * np.maximum(n, m).astype(np.int64)


def _may_link(distance: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The bitmaps' distance is at most the symmetric difference, which a link keeps small."""
    return (100 + THRESHOLD) * distance.astype(np.int64) <= (100 - THRESHOLD) * (n.astype(np.int64) + m.astype(np.int64))


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact test on sorted arrays."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= THRESHOLD * (len(x) + len(y) - shared)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for first, data, offsets in T.slices(batch.column("text")):
            yield batch, first, T.shingle_sets(data, offsets, SHINGLE)


def _measured(source: DataFrame, seed: int) -> DataFrame:
    """Rows of documents (doc_id, tie, n_shingles, node, twin, size in bytes of text and set) and rows of locally frequent shingles (shingle, found)."""
    key = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "tie", "n_shingles", "node", "twin", "size", "shingle", "found"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kind = None

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = counts >= 3
            values, counts = values[often].view(np.int64), counts[often].astype(np.int64)
            empty = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(values), kind), *[empty] * 5, pa.array(values), pa.array(counts)], names)

        for batch, first, sets in _sets(batches):
            kind = batch.column("doc_id").type
            identities = [_identity(s, seed) if len(s) else (None, None) for s in sets]
            nodes, twins = zip(*identities, strict=True)
            empty = pa.nulls(len(sets), pa.int64())
            n = pa.array([len(s) for s in sets], pa.int64())
            bytes_of = pc.coalesce(pc.binary_length(batch.column("text").slice(first, len(sets))), pa.scalar(0, pa.int32()))
            size = pc.add(pc.cast(bytes_of, pa.int64()), pc.multiply(n, pa.scalar(8, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(sets)), batch.column("tie").slice(first, len(sets)), n, pa.array(nodes, pa.int64()), pa.array(twins, pa.int64()), size, empty, empty], names)
            held += sets
            if sum(map(len, held)) > 500_000:
                yield frequent()
        if held:
            yield frequent()

    return source.mapInArrow(measure, f"doc_id {key}, tie bigint, n_shingles bigint, node bigint, twin bigint, size bigint, shingle bigint, found bigint")


def _prefixes(source: DataFrame, frequent: tuple[np.ndarray, np.ndarray], seed: int) -> DataFrame:
    """For each set that a task meets: node, n, bitmap, prefix (hashes, rare ones first)."""
    shared = source.sparkSession.sparkContext.broadcast(frequent)
    names = ["node", "n", "bitmap", "prefix"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        seen: set[int] = set()
        for _, _, sets in _sets(batches):
            rows = []
            for own in sets:
                if not len(own) or (node := _identity(own, seed)[0]) in seen:
                    continue
                seen.add(node)
                count = len(own) - -(-THRESHOLD * len(own) // 100) + 1
                prefix = own[:count]
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    usual = common[at] == own
                    rare = own[~usual]
                    if len(rare) < count:
                        rest = own[usual]
                        rest = rest[np.lexsort((rest, counts[at[usual]]))]
                        rare = np.concatenate([rare, rest])
                    prefix = rare[:count]
                rows.append((node, len(own), _bitmap(own).tobytes(), prefix.tobytes()))
            if rows:
                node, n, bitmap, prefix = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(bitmap, pa.binary()), pa.array(prefix, pa.binary())], names)

    return source.mapInArrow(take, "node bigint, n int, bitmap binary, prefix binary")


def _elements(prefixes: DataFrame, buckets: int) -> DataFrame:
    """Prefix shingles dealt to buckets by hash, packed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = [np.frombuffer(x.as_py(), "<u8") for x in batch.column("prefix")]
            if not prefix:
                continue
            sizes = np.array([len(x) for x in prefix])
            rows = np.empty(int(sizes.sum()), _ELEMENT)
            rows["hash"] = np.concatenate(prefix)
            rows["node"] = np.repeat(batch.column("node").to_numpy(), sizes)
            rows["n"] = np.repeat(batch.column("n").to_numpy(), sizes)
            bucket = ((rows["hash"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            parts = [x.tobytes() for x in np.split(rows, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "part"])

    return prefixes.select("node", "n", "prefix").mapInArrow(deal, "bucket int, part binary")


def _tiles(table: pa.Table) -> pa.Table:
    """Pairs (large false: a, b) of small tiles and members (large true: a = tile, b = set) of large ones."""
    rows = np.concatenate([np.frombuffer(x.as_py(), _ELEMENT) for x in table.column("part")])
    rows = rows[np.lexsort((rows["node"], rows["n"], rows["hash"]))]
    again = (rows["hash"][1:] == rows["hash"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
    rows = rows[np.append(True, ~again)]
    heads = np.flatnonzero(np.append(True, rows["hash"][1:] != rows["hash"][:-1]))
    sizes = np.diff(np.append(heads, len(rows)))
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL_TILE)]).tolist():
        i, j = np.triu_indices(size, 1)
        own = heads[sizes == size][:, None]
        firsts.append((own + i).ravel())
        seconds.append((own + j).ravel())
    first, second = rows[np.concatenate(firsts)], rows[np.concatenate(seconds)]
    fit = _fits(first["n"], second["n"])
    first, second = first["node"][fit], second["node"][fit]
    pairs = np.unique(np.stack([np.minimum(first, second), np.maximum(first, second)], 1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
    large = np.repeat(sizes > SMALL_TILE, sizes)
    members = rows[large]
    a = np.concatenate([pairs[:, 0], members["hash"].view(np.int64)])
    b = np.concatenate([pairs[:, 1], members["node"]])
    n = np.concatenate([np.zeros(len(pairs), np.int32), members["n"].astype(np.int32)])
    return pa.table({"large": pa.array(np.arange(len(a)) >= len(pairs)), "a": a, "b": b, "n": n})


def _bitmaps_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        maps = [[np.frombuffer(x.as_py(), "<u8") for x in batch.column(c)] for c in ("bitmap_a", "bitmap_b")]
        widths = np.array([[len(x) for x in side] for side in maps])
        distance = np.zeros(len(n), np.int64)
        for u, v in np.unique(widths, axis=1).T.tolist():
            own = np.flatnonzero((widths[0] == u) & (widths[1] == v))
            left, right = (_folded(np.stack([side[i] for i in own]), min(u, v)) for side in maps)
            distance[own] = np.bitwise_count(left ^ right).sum(1)
        yield batch.select(["a", "b"]).filter(pa.array(_may_link(distance, n, m)))


def _near(n: np.ndarray, maps: list[np.ndarray]) -> list[np.ndarray]:
    """For each set those after it (in an order of its own) that the bitmaps don't rule out."""
    # a link's sizes, and so its bitmaps' widths, differ by less than a factor of two
    words = np.array([len(x) for x in maps])
    near: list[np.ndarray] = [np.zeros(0, np.int64)] * len(maps)
    for width in np.unique(words).tolist():
        own = np.flatnonzero((words == width) | (words == 2 * width))
        packed = np.stack([_folded(maps[i][None, :], width)[0] for i in own])
        for row in np.flatnonzero(words[own] == width).tolist():
            i = own[row]
            after = np.flatnonzero((own > i) | (words[own] > width))
            fit = _fits(n[i : i + 1], n[own[after]])
            after, j = after[fit], own[after][fit]
            distance = np.bitwise_count(packed[row] ^ packed[after]).sum(1)
            near[i] = np.append(near[i], j[_may_link(distance, n[i : i + 1], n[j])])
    return near


def _known(labels: np.ndarray) -> np.ndarray:
    """For each set the first one with its label: what is connected already."""
    _, first, own = np.unique(labels, return_index=True, return_inverse=True)
    return first[own]


def _stars(nodes: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.Table:
    """Links that take the connections before to those after."""
    new = np.unique(np.stack([before, after], 1)[before != after], axis=0)
    return pa.table({"a": pa.array(nodes[new[:, 0]], pa.int64()), "b": pa.array(nodes[new[:, 1]], pa.int64())})


def _bitmap_links(table: pa.Table) -> pa.Table:
    """What the bitmaps of the sets that meet in one task connect."""
    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    maps = [np.frombuffer(table.column("bitmap")[i].as_py(), "<u8") for i in first.tolist()]
    before = _known(table.column("label").to_numpy()[first])
    root = before.copy()
    for i, others in enumerate(_near(table.column("n").to_numpy()[first], maps)):
        joined = np.unique(root[np.append(others, i)])
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
    return _stars(nodes, before, root)


def _text_links(table: pa.Table) -> pa.Table:
    """Links among the sets that meet in one task, as a star for each component."""
    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    own = table.select(["text", "label"]).take(pa.array(first)).combine_chunks()
    sets = [s for _, data, offsets in T.slices(own.column("text").chunk(0)) for s in T.shingle_sets(data, offsets, SHINGLE)] if len(nodes) else []
    before = _known(own.column("label").to_numpy())
    root = before.copy()
    near = _near(np.array([len(s) for s in sets]), [_bitmap(s) for s in sets])
    count = [len(x) for x in near]
    left, right = np.repeat(np.arange(len(sets)), count), np.concatenate([np.zeros(0, np.int64), *near])
    left, right = np.append(left, right), np.append(right, left)
    order = np.argsort(left, kind="stable")
    right, at = right[order], np.searchsorted(left[order], np.arange(len(sets) + 1))
    tried: set[tuple[int, int]] = set()
    for i in np.argsort(-np.diff(at), kind="stable").tolist():
        others = right[at[i] : at[i + 1]]
        for j in others[root[others] != root[i]].tolist():
            pair = (min(i, j), max(i, j))
            if root[i] == root[j] or pair in tried:
                continue
            if _links(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
            else:
                tried.add(pair)
    return _stars(nodes, before, root)


def _tile_groups(members: DataFrame) -> DataFrame:
    """``(group, node, size)``: members of large tiles, with about their bitmaps' bytes, by neighbouring bands of sizes where a tile is more than a block."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / THRESHOLD) * 1.000001)).cast("int")
    banded = members.withColumn("band", band)
    tiles = banded.groupBy("tile").agg(F.count("*").alias("rows"), F.collect_set("band").alias("bands"))
    key = lambda b: F.concat_ws(":", "tile", b)
    own = F.array(key(F.col("band")))
    several = F.when(F.array_contains("bands", F.col("band") - 1), F.concat(own, F.array(key(F.col("band") - 1)))).otherwise(own)
    group = F.explode(F.when(F.col("rows") <= BLOCK, F.array(key(F.lit("")))).otherwise(several))
    return banded.join(tiles, "tile").select(group.alias("group"), "node", F.col("n").cast("bigint").alias("size"))


def _linked(members: DataFrame, payload: DataFrame, kernel: Callable[[pa.Table], pa.Table], name: str) -> DataFrame:
    """Links ``(a, b)`` that ``kernel`` finds among the sets of each group; every pair of a group's sets has
    met or is connected by links that are returned. ``members``: (group, node, size in bytes); ``payload``: (node, ...)."""
    sizes = members.groupBy("group").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    placed = written(members.join(sizes, "group"), f"{name}-members")
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)), F.least(n, F.ceil(size / F.lit(BLOCK_BYTES)))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def met(cells: DataFrame, step: str) -> DataFrame:
        return written(cells.join(payload, "node").groupBy("cell").applyInArrow(kernel, "a bigint, b bigint"), f"{name}-{step}")

    own = F.when(F.col("rows") > LEAST_PIVOTS, blocks(F.col("rows"), F.col("bytes"))).otherwise(1)
    pivots = F.least(F.lit(PIVOTS), F.greatest(F.lit(LEAST_PIVOTS), F.floor(F.col("rows") / own)))
    pivot = (own > 1) & (F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("rows")) < pivots)
    dealt = placed.select("group", "node", F.explode(F.when(pivot, upto(own)).otherwise(F.array(spread(own)))).alias("block"))
    first = met(dealt.select(F.concat_ws(":", "group", "block").alias("cell"), "node", F.col("node").alias("label")), "links")
    large = placed.filter(own > 1)
    if large.isEmpty():
        return first
    labels = written(components(first), f"{name}-labels").withColumnRenamed("root", "label")
    labelled = written(large.join(labels, "node", "left").select("group", "node", "size", F.coalesce("label", "node").alias("label")), f"{name}-labelled")
    counts = labelled.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = counts.groupBy("group").agg(F.max(F.struct("n", "label", "bytes")).alias("main"), F.sum("n").alias("all"), F.sum("bytes").alias("bytes"))
    left = F.col("all") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")
    apart = groups.filter(F.col("main.n") < F.col("all")).select("group", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("inner"), blocks(*left).alias("outer"))
    apart = written(apart, f"{name}-apart")
    if apart.isEmpty():
        return first
    outer, inner = spread(F.col("outer")), spread(F.col("inner"))
    cell = lambda *parts: F.concat_ws(":", "group", *parts)
    outside = F.concat(
        F.transform(upto(F.col("outer")), lambda t: cell(F.lit("o"), F.least(outer, t), F.greatest(outer, t))),
        F.transform(upto(F.col("inner")), lambda t: cell(F.lit("i"), outer, t)),
    )
    inside = F.transform(upto(F.col("outer")), lambda t: cell(F.lit("i"), t, inner))
    rest = labelled.join(apart, "group").select("node", "label", F.explode(F.when(F.col("label") == F.col("main"), inside).otherwise(outside)).alias("cell"))
    return first.unionByName(met(rest, "rest"))


def _classes(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, tie, n_shingles, node) and sets (node, root, component_id, first)."""
    seed = 0
    while True:
        measured = written(_measured(source, seed), "sets-measured")
        documents = measured.filter("shingle is null").select("doc_id", "tie", "n_shingles", "node", "twin", "size")
        key = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
        classes = written(documents.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("smallest"), key, F.max("size").alias("size"), F.min("twin").alias("_t"), F.max("twin").alias("_u")), "set-classes")
        if classes.filter("_t <> _u").isEmpty():
            break
        seed += 1
    n = F.col("n_shingles")
    rows, shingles, elements = documents.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(n - F.ceil(n * THRESHOLD / 100) + 1), F.lit(0))).first()
    often = max(FREQUENT_COUNT, int(rows * FREQUENT_SHARE), -(-shingles // FREQUENT_MOST))
    frequent = measured.filter("shingle is not null").groupBy("shingle").agg(F.sum("found").alias("found")).filter(F.col("found") >= often).toArrow()
    hashes, counts = frequent.column("shingle").to_numpy().view(np.uint64), frequent.column("found").to_numpy()
    order = np.argsort(hashes)

    prefixes = written(_prefixes(source, (hashes[order], counts[order]), seed), "set-prefixes")
    buckets = max(1, -(-int(elements) // BUCKET_ELEMENTS))
    # dealt to a stated number of tasks, which aren't coalesced
    dealt = _elements(prefixes, buckets).repartition(min(buckets, BUCKET_TASKS), "bucket")
    tiles = written(dealt.groupBy("bucket").applyInArrow(_tiles, "large boolean, a bigint, b bigint, n int"), "set-tiles")

    bitmaps = prefixes.select("node", "n", "bitmap").dropDuplicates(["node"])
    side = lambda s: bitmaps.select(*[F.col(c).alias(f"{c}_{s}" if c != "node" else s) for c in bitmaps.columns])
    pairs = tiles.filter("not large").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    members = tiles.filter("large").select(F.col("a").alias("tile"), F.col("b").alias("node"), "n").distinct()
    passed = written(pairs.mapInArrow(_bitmaps_pass, "a bigint, b bigint"), "set-pairs")
    if not members.isEmpty():
        passed = passed.unionByName(_linked(_tile_groups(members), bitmaps, _bitmap_links, "tile"))
    plain = classes.select("node", F.col("node").alias("root"), F.col("smallest").alias("component_id"), "first")
    if passed.isEmpty():
        return documents, plain
    clusters = written(components(passed).join(classes.select("node", "first", "size"), "node"), "set-clusters")
    firsts = clusters.select("node", F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_tie"))
    # clusters grow with the corpus: the same join at every size
    texts = source.join(firsts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("node", "text").dropDuplicates(["node"])
    links = _linked(clusters.select(F.col("root").cast("string").alias("group"), "node", "size"), texts, _text_links, "set")
    if links.isEmpty():
        return documents, plain
    roots = components(links)
    least = roots.join(classes, "node").groupBy("root").agg(F.min("smallest").alias("component_id"), F.min("first").alias("first"))
    linked = written(roots.join(least, "root"), "set-components")
    alone = plain.join(linked, "node", "left_anti")
    return documents, alone.unionByName(linked.select(*alone.columns))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("tie"), F.col(f"`{text_col}`").alias("text"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (smallest id reachable), node (its set)."""
    documents, classes = _classes(_rows(docs, id_col, text_col))
    columns = ["doc_id", "n_shingles", "component_id", "node"]
    # documents without a set would all meet under one key
    none = documents.filter("node is null").withColumn("component_id", F.col("doc_id")).select(*columns)
    return documents.filter("node is not null").join(classes.select("node", "component_id"), "node").select(*columns).unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar ones: the one with the smallest id, of several such
    the one with the least hash of its text, of equal rows any. A row without an id stays only where no
    similar one has an id. Rows without words all stay.
    """
    documents, classes = _classes(_rows(docs, id_col, text_col))
    keys = documents.filter("node is not null").groupBy("doc_id", "tie").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    judged = written(keys.join(classes.select("node", "first"), "node").select("doc_id", "tie", "n", own.alias("stays")).filter("not stays or n > 1"), "set-judged")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(f"`{text_col}`").alias("_tie"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie"))
    kept = rows.join(judged.select("doc_id", "tie"), same, "left_anti").select("_row")
    again = judged.filter("stays")
    if not again.isEmpty():
        repeated = rows.join(again.select("doc_id", "tie"), same, "left_semi").dropDuplicates(["_id", "_tie"])
        kept = kept.unionByName(repeated.select("_row"))
    return kept.select("_row.*")
