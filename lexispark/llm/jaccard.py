"""Exact Jaccard self-join of shingle sets as a metric-space join with pivots, regions and windows.

Distance here is the size H of the symmetric difference; Jaccard similarity of T or more means H <= (|x| + |y|) * (1 - T) / (1 + T).
Distances between unrelated documents are all nearly the greatest possible, so regions around whole documents would
hold everything. The shingle universe is therefore cut into slices by hash, each a metric space of its own; H is the sum
of the slices' distances. With more slices than H may be, a linked pair agrees in a slice that is not empty, so each
document lies in a region at distance 0 of a pivot in one of its first H + 1 slices. Sizes are cut in narrow rings
around the empty set, each with as few slices as that allows; a document whose window reaches the next ring is replicated there. The pivot of a region is its
least set. Within regions, triangle inequalities to the empty pivot of 512 coarse slices bound H from below. Sets are
first compared with the nearest pivot they share a region with; of regions that this leaves in several components,
crowded ones are joined again by themselves: their sets share passages, so they go by their rarest shingles, of which a
linked pair shares one among the first H + 1, too, in any order that holds for all sets. What is left open is joined
exactly, large regions in pairs of chunks. Nothing is dropped: each step keeps every pair that may be linked.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fits_broadcast, mix64, small_batches, written
from .packed import Packer, by_part, grouped, parts_for, runs, schema, unpacked

WIDTH = 5
PERCENT = 80
COARSE = 512
SMALL = 40  # sets of smaller rings go by their first shingles instead of slices
SPARE = 8
CHUNK = 128
SALTS = 32  # pieces of a pivot's rows where they meet rows of a few bytes that are too many to broadcast
FREQUENT = 16  # shingles of more sets than this count as common in crowded regions
MOST_FREQUENT = 1 << 18  # common shingles that are told to all tasks; a list of the most common ones is as exact as any
MULT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of all its words as one if they are fewer than WIDTH."""
    words = (text or "").encode().lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    width = min(WIDTH, len(w))
    h = w[: len(w) - width + 1].copy()
    for k in range(1, width):
        h = mix64(h * MULT + w[k : len(w) - width + 1 + k])
    return np.unique(mix64(h + np.uint64(width)))


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=COARSE), 255).astype(np.uint8).tobytes()


def most_apart(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The greatest symmetric difference at which sets of these sizes are linked."""
    return (a + b) * (100 - percent) // (100 + percent)


def linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


@functools.cache
def rings(percent: int, upto: int) -> tuple[int, ...]:
    """Least sizes of the rings; each is so wide that a set's partners of its size or more lie in its own ring or the next."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // percent)))
    return tuple(edges)


@functools.cache
def slices(least: int, end: int, percent: int) -> int:
    """The fewest slices for a ring in which sets of all its sizes fill more slices than H may be, by SPARE standard deviations.

    0 where no count does that at a few slices a shingle (small sets, low percentages); such a ring goes by first shingles.
    Few slices hold many shingles each, so that unrelated sets with a passage in common seldom agree in one.
    """
    sizes = [-(-least * percent // 100), least, end - 1]
    count = most_apart(end - 1, end - 1, percent) + 1

    def filled(n: int) -> float:
        load = n / count
        return count * (1 - math.exp(-load)) - SPARE * math.sqrt(count * (math.exp(-load) - (1 + load) * math.exp(-2 * load)))

    while least >= SMALL and count <= 4 * end:
        if all(filled(n) >= most_apart(n, min(100 * n // percent, end - 1), percent) + 1 for n in sizes):
            return count
        count += 1 + count // 64
    return 0


def region_keys(s: np.ndarray, percent: int, ordered: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Keys of the regions of a set, for its ring and, if its window reaches it, the next one: by slices or, if given, by the first of its ordered shingles."""
    n, partner = len(s), 100 * len(s) // percent
    edges = rings(percent, 1 << (2 * partner).bit_length() + 1)
    ring = bisect.bisect_right(edges, n) - 1
    for r in (ring, ring + 1) if partner >= edges[ring + 1] else (ring,):
        need = most_apart(n, min(partner, edges[r + 1] - 1), percent) + 1
        count = slices(edges[r], edges[r + 1], percent) if ordered is None else 0
        if not count:
            keys = (s if ordered is None else ordered)[:need].copy()
        else:
            piece = (s >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
            starts, _ = runs(piece)
            if len(starts) < need:  # SPARE standard deviations off: only a hash that fails its purpose gets here
                raise ArithmeticError(f"{len(starts)} of {count} slices hold shingles, {need} are needed: a link could be lost")
            keys = np.add.reduceat(mix64(s), starts)[:need] + piece[starts[:need]]
        yield mix64(keys * MULT + np.uint64(r))


def profiles(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (the set's hash, null if empty), hist."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, node, hist = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, hashes)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                hist.append(histogram(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(hist, pa.binary())], names=["doc_id", "n_shingles", "node", "hist"])

    return documents.mapInArrow(rows, "doc_id bigint, n_shingles bigint, node bigint, hist binary")


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(first)]
    return first[new], second[new]


def met_regions(packed: DataFrame, parts: int) -> DataFrame:
    """(pivot, node) of every region that holds two sets or more, the pivot with itself included; packed: keys and nodes.

    Each part's pairs are distinct; they travel packed to the part of the pair's hash, where they become distinct.
    """
    names = ["pairs", "pivots", "nodes"]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = distinct_pairs(*unpacked(batches, [np.uint64, np.int64]))
        starts, ends = runs(keys)
        size = ends - starts
        many = np.repeat(size > 1, size)
        pivot, node = distinct_pairs(np.repeat(nodes[starts], size)[many], nodes[many])
        packer = Packer(parts, names)
        yield from packer.add(mix64(pivot.view(np.uint64) * MULT + node.view(np.uint64)), pivot, node)
        yield from packer.flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, node = distinct_pairs(*unpacked(batches, [np.uint64, np.int64, np.int64])[1:])
        for a in range(0, len(pivot), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pivot[a : a + 100_000]), pa.array(node[a : a + 100_000])], names=["pivot", "node"])

    met = by_part(packed, parts).mapInArrow(gathered, schema(names))
    return by_part(met, parts).mapInArrow(merged, "pivot bigint, node bigint")


def regions(documents: DataFrame, entries: int, percent: int) -> DataFrame:
    """(pivot, node) of the regions of all documents, by slices."""
    parts = parts_for(documents, entries)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer, met = WordHashes(), Packer(parts, ["keys", "nodes"]), set()
        for b in batches:
            for text in b.column(1).to_pylist():
                s = shingles(text, hashes)
                node = node_of(s) if len(s) else None
                if node is None or node in met:
                    continue
                if len(met) < 100_000:
                    met.add(node)
                for keys in region_keys(s, percent):
                    yield from packer.add(keys, np.full(len(keys), node, np.int64))
        yield from packer.flush()

    return met_regions(documents.mapInArrow(keyed, schema(["keys", "nodes"])), parts)


def common_shingles(sets: DataFrame, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the most sets, sorted, and their numbers of sets: those of over FREQUENT sets or, so that no more than MOST_FREQUENT are, of a multiple of that."""
    parts = parts_for(sets, entries)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts, ["keys"])
        for b in batches:
            for x in b.column(1).to_pylist():
                yield from packer.add(np.frombuffer(x, np.uint64))
        yield from packer.flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(unpacked(batches, [np.uint64])[0])
        starts, ends = runs(keys)
        often = ends - starts > FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(keys[starts[often]].view(np.int64)), pa.array((ends - starts)[often])], names=["shingle", "often"])

    found = written(by_part(sets.mapInArrow(keyed, schema(["keys"])), parts).mapInArrow(counted, "shingle bigint, often bigint"), "common")
    least = FREQUENT
    while found.filter(F.col("often") > least).count() > MOST_FREQUENT:
        least *= 2
    t = found.filter(F.col("often") > least).toArrow()
    shingle, often = t.column("shingle").to_numpy().view(np.uint64), t.column("often").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], often[order]


def inner_regions(sets: DataFrame, entries: int, percent: int) -> DataFrame:
    """(pivot, node) of the regions of the sets (node, set), by their rarest shingles."""
    parts = parts_for(sets, entries)
    common = sets.sparkSession.sparkContext.broadcast(common_shingles(sets, entries))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts, ["keys", "nodes"])
        shingle, often = common.value
        for b in batches:
            for node, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(x, np.uint64)
                ordered = s
                if len(shingle):
                    at = np.minimum(np.searchsorted(shingle, s), len(shingle) - 1)
                    ordered = s[np.argsort(np.where(shingle[at] == s, often[at], 0), kind="stable")]
                for keys in region_keys(s, percent, ordered):
                    yield from packer.add(keys, np.full(len(keys), node, np.int64))
        yield from packer.flush()

    found = written(met_regions(sets.mapInArrow(keyed, schema(["keys", "nodes"])), parts), "inner-regions")
    common.destroy()
    return found


def counts_of(binary: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), np.uint8).reshape(-1, COARSE).astype(np.int16)


def bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, na, nb, ha, hb) whose lower bound of H allows a link, as (a, b, bound)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            bound = np.abs(counts_of(b.column(4)) - counts_of(b.column(5))).sum(axis=1, dtype=np.int64)
            keep = pa.array(bound <= most_apart(na, nb, percent))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bound)], names=["a", "b", "bound"])
            yield out.filter(keep)

    return pairs.mapInArrow(rows, "a bigint, b bigint, bound bigint")


def compared(pairs: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, sa, sb) whose sets are linked, as (a, b)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(bool(linked(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v), percent)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(rows, "a bigint, b bigint")


def block_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a block (rows chunk, lo, hi, comp) that belong to it and lie in different components."""
    chunk, comp = t.column("chunk").to_numpy(), t.column("comp").to_numpy()
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    first, second = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
    i, j = np.repeat(first, len(second)), np.tile(second, len(first))
    keep = comp[i] != comp[j]
    if lo == hi:
        keep &= i < j
    return i[keep], j[keep]


def may_link(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = block_pairs(t)
    n = t.column("n").to_numpy()
    h = counts_of(t.column("hist"))
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 8192):
        x, y = i[a : a + 8192], j[a : a + 8192]
        keep[a : a + 8192] = np.abs(h[x] - h[y]).sum(axis=1, dtype=np.int64) <= most_apart(n[x], n[y], percent)
    return i[keep], j[keep]


def near_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Of each block, sorted and kept together, the pairs that may be linked across components: a < b, and the block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["pivot", "lo", "hi"]):
            i, j = may_link(t, percent)
            if len(i):
                node = t.column("node").to_numpy()
                x, y = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                k = len(x)
                block = [pa.array(np.full(k, t.column(c)[0].as_py(), kind)) for c, kind in (("pivot", np.int64), ("lo", np.int32), ("hi", np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *block], names=["a", "b", "pivot", "lo", "hi"])

    return blocks.mapInArrow(rows, "a bigint, b bigint, pivot bigint, lo int, hi int")


def joined_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links of each block as (a, b), a spanning forest of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["pivot", "lo", "hi"]):
            i, j = may_link(t, percent)
            if not len(i):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            n = np.array([len(s) for s in sets])
            if len(i) <= 2 * len(sets):
                both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
            else:
                _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                place = np.cumsum(often > 1) - 1
                wide, row = int((often > 1).sum()), np.repeat(np.arange(len(sets)), n)
                keep = often[column] > 1
                row, column = row[keep], place[column[keep]]
                total = np.zeros((len(sets), len(sets)), np.float32)
                for a in range(0, wide, 16_384):  # products of slabs of the sets' matrix
                    here = (column >= a) & (column < a + 16_384)
                    m = np.zeros((len(sets), min(16_384, wide - a)), np.float32)
                    m[row[here], column[here] - a] = 1
                    total += m @ m.T
                both = total[i, j].astype(np.int64)
            good = linked(both, n[i], n[j], percent)
            node = t.column("node").to_numpy()
            root = list(range(len(sets)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            a, b = [], []
            for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                if find(x) != find(y):
                    root[find(x)] = find(y)
                    a.append(node[x])
                    b.append(node[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.mapInArrow(rows, "a bigint, b bigint")


def sets_of(documents: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes, from one document of each."""
    keys = written(wanted.join(nodes, "node").select("node", F.col("rep").alias("doc_id")), "wanted")
    ids = keys.select("doc_id").distinct()
    docs = documents.join(F.broadcast(ids) if fits_broadcast(keys, 40) else ids, "doc_id", "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t, hashes) for t in b.column(1).to_pylist()]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    found = docs.mapInArrow(rows, "node bigint, set binary").join(keys.select("node"), "node", "left_semi")
    return written(found.groupBy("node").agg(F.first("set").alias("set")), "sets")


def with_pivots(rows: DataFrame, pivots: DataFrame, how: str = "inner") -> DataFrame:
    """rows (pivot, node, ..) joined with pivots (already written, a row of a few numbers for each pivot), so that no task gathers a pivot's rows.

    pivots are broadcast if their size allows it; beyond, each pivot's rows are salted by node and its row is copied to the salts.
    """
    if fits_broadcast(pivots, 40):
        return rows.join(F.broadcast(pivots), "pivot", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    copied = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copied, ["pivot", "salt"], how).drop("salt")


def star_links(cand: DataFrame, known: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets with the nearest pivot that they share a region with; a pivot goes to a piece of its region per CHUNK sets."""
    side = lambda name, k: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{k}"), F.col("hist").alias(f"h{k}"))
    member = cand.filter("pivot <> node")
    hot = written(member.groupBy("pivot").agg(F.count("*").alias("g")).filter(F.col("g") > CHUNK).select("pivot", F.ceil(F.col("g") / CHUNK).cast("int").alias("pieces")), "hot-pivots")
    pieces = F.coalesce("pieces", F.lit(1))
    member = with_pivots(member, hot, "left").select("node", "pivot", F.pmod(F.xxhash64("node"), pieces).cast("int").alias("piece"))
    pivots = side("pivot", "b").join(hot, "pivot", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    star = member.join(side("node", "a"), "node").join(pivots, ["pivot", "piece"]).select(F.col("node").alias("a"), F.col("pivot").alias("b"), "na", "nb", "ha", "hb")
    star = written(bounded(star, percent).groupBy("a").agg(F.min_by("b", F.struct("bound", "b")).alias("b")), "star")
    sets = sets_of(known, nodes, star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct())
    near = star.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    return written(compared(near, percent), "links")


def open_regions(cand: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cand with the components of its nodes, and of the regions that lie in several the pivot and size g, written."""
    open_ = cand.join(comp, "node", "left").select("pivot", "node", F.coalesce("component", "node").alias("comp"))
    split = open_.groupBy("pivot").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("g")).filter("c0 <> c1").select("pivot", "g")
    return open_, written(split, "split-regions")


def similar_documents(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A document without words is linked with nothing and is its own component; so is every row without a doc_id, whose
    component_id is null. Equal sets are one node of the graph, however many documents have them.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    known = docs.filter("doc_id is not null")
    profile = written(profiles(docs), "profiles")
    nodes = written(profile.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("hist").alias("hist")), "nodes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cand = written(regions(known, int(total * 0.5), percent), "regions")
    links = star_links(cand, known, nodes, percent)
    comp = components(links, "star-components")
    open_, split = open_regions(cand, comp)
    crowd = written(split.filter(F.col("g") > CHUNK).select("pivot"), "crowded")
    if not crowd.isEmpty():
        # pairs of a crowded region meet again among all sets of such regions, by their rarest shingles
        inside = sets_of(known, nodes, with_pivots(cand, crowd, "left_semi").select("node").distinct())
        held = inside.agg(F.coalesce(F.sum(F.octet_length("set")), F.lit(0))).first()[0] // 8
        inner = inner_regions(inside, held, percent)
        links = links.unionByName(star_links(inner, known, nodes, percent))
        comp = components(links, "inner-components")
        cand = written(with_pivots(cand, crowd, "left_anti").select("pivot", "node").unionByName(inner).distinct(), "open-regions")
        open_, split = open_regions(cand, comp)
    # regions left in several components, in blocks of chunk pairs
    block = with_pivots(open_, split).withColumn("chunks", F.ceil(F.col("g") / CHUNK).cast("int")).drop("g").join(nodes.select("node", "n", "hist"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = block.select("pivot", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "comp", "n", "hist")
    together = lambda df: df.repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi", "chunk", "node")
    # a pair meets at several pivots; it is settled at the least, so that a set goes to few blocks
    pairs = near_blocks(together(block), percent).groupBy("a", "b").agg(F.min(F.struct("pivot", "lo", "hi")).alias("at"))
    close = written(pairs.select("at.*", F.explode(F.array("a", "b")).alias("node")).distinct(), "blocks")
    if not close.isEmpty():
        close = close.join(block, ["pivot", "lo", "hi", "node"])
        more = sets_of(known, nodes, close.select("node").distinct())
        links2 = joined_blocks(together(close.join(more, "node")), percent)
        comp = components(links.unionByName(written(links2, "links")), "all-components")
    label = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).select("node", "component", "rep")
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "component").select("node", "component_id")
    out = profile.join(label, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
