"""Duplicate substrings by enhanced suffix arrays over content-defined anchors.

Every LENGTH-byte string holds an anchor: the GRAM-byte string of least hash among its LENGTH - GRAM + 1 (winnowing), so
equal strings hold equal anchors at equal places. Anchors that occur once settle that no repeat passes there. The
others meet by their hash with the context that a string of LENGTH bytes around them can reach. The right contexts of a
meeting are sorted with their common prefixes: an enhanced suffix array. A stack scan gives its common-prefix intervals;
inside each, the left contexts are sorted and scanned likewise. An interval of left contexts whose members differ before
it, and after the right prefix, is a maximal repeat with all its occurrences, as far as the contexts reach. Meetings of
more than MOST members are not gathered: there each string around the anchor goes by its own hash, and those met twice
are repeats. A key that one task's buffer holds many times is settled there and sends a marker instead of its entries,
so no part gathers a hot key. Equal texts are one text with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, mix64, small_batches, written
from .packed import Packer, by_part, parts_for, runs, schema, unpacked

LENGTH = 400
GRAM = 300
MOST = 200
HOT = 32  # entries of one anchor in a task's buffer that settle it as crowded
ASKS, MARKS, SETTLED = 0, 1, 2
BASE = 0x9E3779B97F4A7C15
CONTEXT = ["keys", "texts", "places", "left", "right", "n_left", "n_right"]
BOUNDS = ["first", "last"]


class Rolling:
    """64-bit hashes of all byte strings of one length in a text, from running sums modulo 2 ** 64."""

    def __init__(self) -> None:
        self.table = np.random.RandomState(11).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = getattr(self, name)
                setattr(self, name, np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))]))

    def sums(self, b: np.ndarray) -> np.ndarray:
        self.powers(len(b) + 1)
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.up[: len(b)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        return mix64((sums[start + length] - sums[start]) * self.down[start])

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        return mix64((sums[length:] - sums[:-length]) * self.down[: len(sums) - length])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    m = x
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - w : width - w + len(x) - width + 1])


def window_anchors(hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of `length` bytes, the place of its least gram, the last of equals; places never fall."""
    width = length - gram + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 30) - 1)
    place = np.arange(len(hashes), dtype=np.uint64) & low
    m = sliding_min((hashes & ~low) | (low - place), width)
    return (low - (m & low)).astype(np.int64)


def anchors(hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    at = window_anchors(hashes, length, gram)
    return at[np.append(True, at[1:] != at[:-1])[: len(at)]]


def common_prefix(rows: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    same = np.cumprod(rows[i] == rows[j], axis=1, dtype=np.int64).sum(axis=1)
    return np.minimum(same, np.minimum(lengths[i], lengths[j]))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of all common-prefix intervals of a suffix array; lcp[i] is that of entries i and i + 1."""
    stack = [(0, 0)]
    for i, x in enumerate([*lcp, -1], 1):
        first = i - 1
        while stack and stack[-1][0] > x:
            height, first = stack.pop()
            if first < i - 1 and (height or 0 in lcp):
                yield height, first, i - 1
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def ordered(context: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The order of contexts; one that ends goes before those that go on, with bytes 0, too."""
    if len(n) < 2:
        return np.arange(len(n))
    key = np.ascontiguousarray(np.concatenate([context, n.astype(np.uint8)[:, None]], axis=1))
    return np.argsort(key.view(f"V{key.shape[1]}").ravel(), kind="stable")


def maximal_repeats(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes to the left, bytes to the right, members) of the maximal repeats around one anchor that have `reach` bytes around it.

    left holds the bytes before the anchor, nearest first. Members of an interval agree in `to the left` bytes and not in
    one more, and neither in one more to the right.
    """
    order = ordered(right, n_right)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    lcp = common_prefix(right, n_right, order[:-1], order[1:])
    for height, first, last in [*intervals(lcp.tolist())]:
        members = order[first : last + 1]
        members = members[ordered(left[members], n_left[members])]
        shared = common_prefix(left, n_left, members[:-1], members[1:])
        for wide, a, b in intervals(shared.tolist()):
            if wide + height < reach:
                continue
            group = members[a : b + 1]
            if len(group) <= last - first:  # otherwise its right prefix is the interval's
                at = rank[group]
                if lcp[at.min() : at.max()].min() > height:
                    continue  # agrees in more bytes to the right: a group of an inner interval
            yield wide, height, group


def meet(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member of one anchor's meeting, the farthest bytes to the left and to the right of the anchor in maximal repeats; -1 where it is in none."""
    far_left, far_right = np.full(len(left), -1, np.int64), np.full(len(left), -1, np.int64)
    for wide, height, group in maximal_repeats(left, n_left, right, n_right, reach):
        far_left[group] = np.maximum(far_left[group], wide)
        far_right[group] = np.maximum(far_right[group], height)
    return far_left, far_right


def thinned(keys: np.ndarray, texts: np.ndarray, places: np.ndarray, most: int) -> list[np.ndarray]:
    """A buffer's distinct entries with flags; those of keys with more than `most` are settled and go by text and stretch of it, with one marker to the key's part."""
    keys, texts, places = distinct_entries(keys, texts, places)
    starts, ends = runs(keys)
    size = ends - starts
    hot = np.repeat(size > most, size)
    first = starts[size > most]
    route = np.concatenate([np.where(hot, mix64(texts.view(np.uint64) + (places >> 16).astype(np.uint64)), keys), keys[first]])
    flags = np.concatenate([np.where(hot, SETTLED, ASKS), np.full(len(first), MARKS)]).astype(np.uint8)
    return [route, np.append(texts, texts[first]), np.append(places, places[first]), flags]


def distinct_entries(keys: np.ndarray, texts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((places, texts, keys))
    keys, texts, places = keys[order], texts[order], places[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1]) | (places[1:] != places[:-1]))[: len(keys)]
    return keys[new], texts[new], places[new]


def asked(batches: Iterator[pa.RecordBatch], crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, places, number of entries of the key, whether it is crowded) of a part's entries; settled ones, and those of marked keys, are crowded."""
    keys, texts, places, flags = unpacked(batches, [np.uint64, np.int64, np.uint32, np.uint8])
    settled = flags == SETTLED
    mark = np.unique(keys[flags == MARKS])
    k, t, p = distinct_entries(keys[~settled], texts[~settled], places[~settled])
    starts, ends = runs(k)
    size = np.repeat(ends - starts, ends - starts)
    many = (size > crowd) | np.isin(k, mark, assume_unique=False)
    over = np.full(int(settled.sum()), crowd + 1)
    return np.append(t, texts[settled]), np.append(p, places[settled]), np.append(np.where(many, np.maximum(size, 2), size), over), np.append(many, over > 0)


def text_key(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def distinct_texts(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[bytes, int]]:
    met: set[int] = set()
    for b in batches:
        for text in b.column(column).to_pylist():
            raw = (text or "").encode()
            if len(raw) >= LENGTH and (key := text_key(raw)) not in met:
                if len(met) < 100_000:
                    met.add(key)
                yield raw, key


def profiles(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([text_key(r) for r in raw], pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())],
                names=["doc_id", "text_key", "n_bytes", "sha256"],
            )

    return docs.mapInArrow(rows, "doc_id bigint, text_key bigint, n_bytes bigint, sha256 string")


def met_anchors(docs: DataFrame, n_bytes: int) -> DataFrame:
    """(text_key, places, crowded) of the anchors that occur at two places or more; crowded: at more than MOST, or HOT in one buffer."""
    parts = parts_for(docs, 2 * n_bytes // (LENGTH - GRAM + 1))
    names = ["keys", "texts", "places", "flags"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, packer = Rolling(), Packer(parts, names, thin=lambda *c: thinned(*c, HOT))
        for raw, key in distinct_texts(batches):
            h = roll.all(roll.sums(np.frombuffer(raw, np.uint8)), GRAM)
            at = anchors(h, LENGTH, GRAM)
            # anchors have the least hashes of their windows: mixed again, they spread over all parts
            yield from packer.add(mix64(h[at]), np.full(len(at), key, np.int64), at.astype(np.uint32))
        yield from packer.flush()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, places, size, crowded = asked(batches, MOST)
        yield from by_text(texts[size > 1], places[size > 1], crowded[size > 1])

    return by_part(docs.mapInArrow(keyed, schema(names)), parts).mapInArrow(gathered, "text_key bigint, places binary, crowded binary")


def by_text(texts: np.ndarray, places: np.ndarray, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((places, texts))
    texts, places, flags = texts[order], places[order].astype(np.uint32), flags[order].astype(np.uint8)
    starts, ends = runs(texts)
    for a in range(0, len(starts), 10_000):
        s, e = starts[a : a + 10_000], ends[a : a + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts[s]), pa.array([places[i:j].tobytes() for i, j in zip(s, e, strict=True)], pa.binary()), pa.array([flags[i:j].tobytes() for i, j in zip(s, e, strict=True)], pa.binary())], names=["text_key", "places", "crowded"]
        )


def span_batches(texts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans as (text_key, spans): merged within the text, packed as begin, end."""
    order = np.lexsort((begin, texts))
    texts, begin, end = texts[order], begin[order], end[order]
    starts, ends = runs(texts)
    for a in range(0, len(starts), 10_000):
        s, e = starts[a : a + 10_000], ends[a : a + 10_000]
        packed = [merged(begin[i:j], end[i:j]).astype(np.uint32).tobytes() for i, j in zip(s, e, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts[s]), pa.array(packed, pa.binary())], names=["text_key", "spans"])


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows of (begin, end) of the union, touching spans joined."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    last = np.append(first[1:], True)[: len(begin)]
    return np.stack([begin[first], end[last]], axis=1)


def contexts(docs: DataFrame, n_anchors: int, bounds: bool = False) -> DataFrame:
    """The meetings of anchors that are not crowded, packed; docs: (text, places, crowded, text_key), one row for each text.

    bounds adds how many bytes before the anchor the first and the last string begin of which it is the anchor.
    """
    reach = LENGTH - GRAM
    parts = parts_for(docs, n_anchors, 1 << 16)
    names = CONTEXT + BOUNDS * bounds

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, packer = Rolling(), Packer(parts, names)
        back, on = -1 - np.arange(reach), np.arange(reach)
        for b in batches:
            for text, places, crowded, key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                if text_key(raw) != key:
                    continue  # another text of the same doc_id
                at = np.frombuffer(places, np.uint32).astype(np.int64)
                at = np.unique(at[np.frombuffer(crowded, np.uint8) == 0])
                x = np.frombuffer(raw, np.uint8)
                sums = roll.sums(x)
                h = mix64(roll.at(sums, at, GRAM))
                windows = window_anchors(roll.all(sums, GRAM), LENGTH, GRAM) if bounds else at
                for a in range(0, len(at), 5_000):
                    p = at[a : a + 5_000]
                    more = [(p - np.searchsorted(windows, p)).astype(np.uint8), (p + 1 - np.searchsorted(windows, p, side="right")).astype(np.uint8)] if bounds else []
                    n_left, n_right = np.minimum(p, reach), np.minimum(len(x) - p - GRAM, reach)
                    left = x[np.maximum(p[:, None] + back, 0)] * (back >= -n_left[:, None])
                    right = x[np.minimum(p[:, None] + GRAM + on, len(x) - 1)] * (on < n_right[:, None])
                    yield from packer.add(h[a : a + 5_000], np.full(len(p), key, np.int64), p.astype(np.uint32), left.astype(np.uint8), right.astype(np.uint8), n_left.astype(np.uint8), n_right.astype(np.uint8), *more)
        yield from packer.flush()

    return by_part(docs.mapInArrow(keyed, schema(names)), parts)


def meetings(batches: Iterator[pa.RecordBatch], bounds: bool = False) -> tuple[np.ndarray, ...]:
    """The columns of a part behind the keys, sorted by anchor, and the starts and ends of the anchors' runs."""
    wide = np.dtype((np.uint8, LENGTH - GRAM))
    keys, *columns = unpacked(batches, [np.uint64, np.int64, np.uint32, wide, wide, np.uint8, np.uint8, *[np.uint8] * 2 * bounds])
    order = np.argsort(keys, kind="stable")
    columns = [c[order] if c.ndim > 1 else c[order].astype(np.int64) for c in columns]
    return *columns, *runs(keys[order])


def context_spans(docs: DataFrame, n_anchors: int) -> DataFrame:
    """(text_key, spans) from the meetings of anchors."""
    reach = LENGTH - GRAM

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, places, left, right, n_left, n_right, starts, ends = meetings(batches)
        far_left, far_right = np.full(len(texts), -1, np.int64), np.full(len(texts), -1, np.int64)
        two = starts[ends - starts == 2]  # one interval of two members each
        for a in range(0, len(two), 10_000):
            i = two[a : a + 10_000]
            r, l = common_prefix(right, n_right, i, i + 1), common_prefix(left, n_left, i, i + 1)
            good = l + r >= reach
            for m in (i[good], i[good] + 1):
                far_left[m], far_right[m] = l[good], r[good]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            far_left[s:e], far_right[s:e] = meet(left[s:e], n_left[s:e], right[s:e], n_right[s:e], reach)
        hit = far_left >= 0
        yield from span_batches(texts[hit], places[hit] - far_left[hit], places[hit] + GRAM + far_right[hit])

    return contexts(docs, n_anchors).mapInArrow(gathered, "text_key bigint, spans binary")


def context_groups(docs: DataFrame, n_anchors: int) -> DataFrame:
    """(length, occurrences) of the maximal repeats in the meetings of anchors; occurrences: (text_key, start) of each."""
    occurrence = pa.struct([("text_key", pa.int64()), ("start", pa.int64())])
    reach = LENGTH - GRAM

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, places, left, right, n_left, n_right, first, last, starts, ends = meetings(batches, True)
        length, groups, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(groups, pa.list_(occurrence))], names=["length", "occurrences"])

        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            for wide, height, group in maximal_repeats(left[s:e], n_left[s:e], right[s:e], n_right[s:e], reach):
                at = s + group[0]
                if min(first[at], wide) < max(last[at], reach - height):
                    continue  # not the anchor of any string inside: this one's occurrences meet elsewhere
                length.append(wide + GRAM + height)
                groups.append([{"text_key": int(t), "start": int(p) - wide} for t, p in zip(texts[s + group], places[s + group], strict=True)])
                held += len(group)
            if held > 10_000:
                yield out()
                length, groups, held = [], [], 0
        yield out()

    return contexts(docs, n_anchors, True).mapInArrow(gathered, "length bigint, occurrences array<struct<text_key:bigint,start:bigint>>")


def crowded_spans(docs: DataFrame, n_anchors: int) -> DataFrame:
    """(text_key, spans) around crowded anchors, each string of LENGTH bytes by its own hash; its rows count as repeated when met twice."""
    parts = parts_for(docs, n_anchors * (LENGTH - GRAM + 1))
    names = ["keys", "texts", "places", "flags"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, packer = Rolling(), Packer(parts, names, thin=lambda *c: thinned(*c, 1))
        for b in batches:
            for text, places, crowded, key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                if text_key(raw) != key:
                    continue  # another text of the same doc_id
                at = np.frombuffer(places, np.uint32).astype(np.int64)[np.frombuffer(crowded, np.uint8) == 1]
                if not len(at):
                    continue
                start = np.unique(at[:, None] - np.arange(LENGTH - GRAM + 1))
                start = start[(start >= 0) & (start + LENGTH <= len(raw))]
                h = roll.at(roll.sums(np.frombuffer(raw, np.uint8)), start, LENGTH)
                yield from packer.add(h, np.full(len(h), key, np.int64), start.astype(np.uint32))
        yield from packer.flush()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, places, size, _ = asked(batches, 1)
        hit, places = size > 1, places.astype(np.int64)
        yield from span_batches(texts[hit], places[hit], places[hit] + LENGTH)

    return by_part(docs.mapInArrow(keyed, schema(names)), parts).mapInArrow(gathered, "text_key bigint, spans binary")


def with_texts(docs: DataFrame, reps: DataFrame, rows: DataFrame, row_bytes: int) -> DataFrame:
    """rows (text_key, ...) with doc_id and text of one document of that text."""
    keyed = written(rows.join(reps.select("text_key", "rep", "rep_bytes"), "text_key"), "keyed")
    side = F.broadcast(keyed) if fits_broadcast(keyed, row_bytes, 96 << 20) else keyed
    return docs.join(side, docs["doc_id"].eqNullSafe(side["rep"])).filter(F.expr("octet_length(text) = rep_bytes")).drop("rep", "rep_bytes")


def anchored(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """profiles of all rows; distinct texts with the copies of each; met anchors with their texts; numbers of anchors and of crowded ones."""
    profile = written(profiles(docs), "profiles")
    groups = written(profile.filter(F.col("n_bytes") >= LENGTH).groupBy("text_key", "sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.min("n_bytes").alias("rep_bytes")), "texts")
    n_bytes = groups.agg(F.coalesce(F.sum("rep_bytes"), F.lit(0))).first()[0]
    met = met_anchors(docs, n_bytes)
    # a text's places, as many binaries as parts that found some
    met = met.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("places", "crowded"))).alias("m"))
    joined = lambda name: F.unhex(F.array_join(F.transform("m", lambda x: F.hex(x[name])), ""))
    met = written(met.select("text_key", joined("places").alias("places"), joined("crowded").alias("crowded")), "anchors")
    stats = met.agg(F.coalesce(F.sum(F.octet_length("crowded")), F.lit(0)), F.coalesce(F.sum(F.length(F.replace(F.hex("crowded"), F.lit("00"), F.lit(""))) / 2), F.lit(0)), F.count("*")).first()
    n_all, n_crowded, n_texts = int(stats[0]), int(stats[1]), int(stats[2])
    at = with_texts(docs, groups, met, 100 + 5 * n_all // max(1, n_texts)).select("text", "places", "crowded", "text_key")
    return profile, groups, at, n_all, n_crowded


def repeat_groups(documents: DataFrame) -> DataFrame:
    """length, occurrences (doc_ids of a text's copies, start) of the maximal repeats of LENGTH bytes or more around anchors.

    A group holds all occurrences of one string in distinct texts; its members differ in the byte before and in the byte
    behind, or end there, as far as LENGTH - GRAM bytes around the anchor show; longer repeats give a group at each of
    their anchors. Anchors at more than MOST places give no groups: without_repeats takes their strings by hash.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    profile, _, at, n_all, n_crowded = anchored(docs)
    groups = written(context_groups(at, n_all - n_crowded).withColumn("group", F.monotonically_increasing_id()), "groups")
    ids = profile.filter(F.col("n_bytes") >= LENGTH).groupBy("text_key").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    places = groups.select("group", "length", F.explode("occurrences").alias("o")).select("group", "length", "o.text_key", "o.start").join(ids, "text_key")
    return places.groupBy("group", "length").agg(F.sort_array(F.collect_list(F.struct("doc_ids", "start"))).alias("occurrences")).select("length", "occurrences")


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; a null text has no bytes.

    Rows of equal doc_id are documents of their own: equal texts repeat each other, whatever their ids.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    profile, groups, at, n_all, n_crowded = anchored(docs)
    spans = context_spans(at, n_all - n_crowded)
    if n_crowded:
        spans = spans.unionByName(crowded_spans(at, n_crowded))
    single = groups.filter("copies = 1").select("text_key")
    spans = written(spans.join(single, "text_key", "left_semi").groupBy("text_key").agg(F.collect_list("spans").alias("spans")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                if text_key(raw) != key:
                    continue  # another text of the same doc_id
                x = np.frombuffer(b"".join(found), np.uint32).reshape(-1, 2).astype(np.int64)
                x = merged(x[:, 0], x[:, 1])
                keep, last = hashlib.sha256(), 0
                for i, j in x.tolist():
                    keep.update(raw[last:i])
                    last = j
                keep.update(raw[last:])
                out.append((hashlib.sha256(raw).hexdigest(), int((x[:, 1] - x[:, 0]).sum()), len(x), keep.hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sha256", "n_removed", "n_spans", "kept"])

    kept = with_texts(docs, groups, spans, 200).select("text", "spans", "text_key").mapInArrow(cut, "sha256 string, n_removed bigint, n_spans bigint, kept string")
    kept = kept.groupBy("sha256").agg(F.first("n_removed").alias("n_removed"), F.first("n_spans").alias("n_spans"), F.first("kept").alias("kept"))
    whole = groups.filter("copies > 1").select("sha256", F.col("rep_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept"))
    found = whole.unionByName(kept)
    zero = F.lit(0).cast("bigint")
    return profile.join(found, "sha256", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"))
