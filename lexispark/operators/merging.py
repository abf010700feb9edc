"""The merge loop of byte-pair encoding over words that stay with the tasks of one barrier stage.

Each task holds its words as arrays of symbols. The first task, the hub, holds the counts of pairs, names the next merge and
hears what it changes in every task's words. Merges and their order are those of `bpe.learn`.
"""

from __future__ import annotations

import heapq
import secrets
import socket
from collections.abc import Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

MOST_TASKS = 64  # the hub hears each of them once a merge; words are dealt to so many, none is left out


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=values, minlength=len(u)).astype(np.int64)  # exact below 2 ** 53


def pair(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    return (a << 32) | b


class Words:
    """Some words as one array of symbols, 0 between words; a piece's symbol stands where it starts and where it ends."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        points, owner, self.n, k = [np.array([10], np.uint32)], [np.zeros(1, np.int32)], [], 0
        for b in batches:
            words = b.column(0).to_pylist()
            self.n.append(b.column(1).to_numpy())
            points.append(np.frombuffer("".join(f"{w}\n" for w in words).encode("utf-32-le"), np.uint32))
            owner.append(np.repeat(np.arange(k, k + len(words), dtype=np.int32), [len(w) + 1 for w in words]))
            k += len(words)
        self.n = np.concatenate([*self.n, np.zeros(1, np.int64)])
        self.owner, self.start = np.concatenate(owner), np.concatenate(points)
        self.where: dict[int, np.ndarray] = {}

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        inside = self.start != 10
        return summed(self.start[inside], self.n[self.owner[inside]])

    def begin(self, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol k + 1 stands for the code point alphabet[k], in ascending order; the counts of pairs."""
        self.start = np.where(self.start == 10, 0, np.searchsorted(alphabet, self.start) + 1).astype(np.int32)
        self.end = self.start.copy()
        self.size = [0] + [1] * len(alphabet)
        order = np.argsort(self.start, kind="stable").astype(np.int32)
        cuts = np.searchsorted(self.start[order], np.arange(len(self.size) + 1))
        self.where = {s: order[cuts[s] : cuts[s + 1]] for s in range(1, len(self.size))}
        a, b = self.start[:-1], self.start[1:]
        at = np.flatnonzero((a != 0) & (b != 0))
        return summed(pair(a[at].astype(np.int64), b[at].astype(np.int64)), self.n[self.owner[at]])

    def merge(self, a: int, b: int, ab: int) -> tuple[np.ndarray, np.ndarray]:
        """Joins a and b wherever they meet, from left to right; the changes in the counts of other pairs."""
        start, end, la, lb = self.start, self.end, self.size[a], self.size[b]
        if ab == len(self.size):
            self.size.append(la + lb)
        none = np.empty(0, np.int32)
        p, q = self.where.get(a, none), self.where.get(b, none)
        if len(p) <= len(q):
            self.where[a] = p = p[start[p] == a]
            p = p[start[p + la] == b]
        else:
            self.where[b] = q = q[start[q] == b]
            p = q[end[q - 1] == a] - np.int32(la)
        if a == b and len(p):  # every other one of a run
            k = np.arange(len(p))
            first = np.maximum.accumulate(np.where(np.diff(p, prepend=-1 - la) != la, k, 0))
            p = p[(k - first) % 2 == 0]
        if not len(p):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n, after = self.n[self.owner[p]], p + la + lb
        left, right = end[p - 1].astype(np.int64), start[after].astype(np.int64)
        end[p + la - 1] = start[p + la] = -1
        start[p] = end[after - 1] = ab
        new_left, new_right = end[p - 1].astype(np.int64), start[after].astype(np.int64)
        self.where[ab] = np.sort(np.concatenate([self.where[ab], p])) if ab in self.where else p
        i, j = left != 0, (right != 0) & (right == new_right)  # a merged neighbour on the right counts this one as its left
        return summed(np.concatenate([pair(left[i], a), pair(new_left[i], ab), pair(b, right[j]), pair(ab, right[j])]), np.concatenate([-n[i], n[i], -n[j], n[j]]))


class Counts:
    """The counts of pairs, and the greatest of them; a heap holds those from a floor on, which sinks when it is empty."""

    def __init__(self, pieces: list[str], longest: int) -> None:
        self.pieces, self.size, self.longest, self.count, self.heap, self.floor = pieces, [], longest, {}, [], 1 << 62

    def push(self, key: int, n: int) -> None:
        heapq.heappush(self.heap, (-n, self.pieces[key >> 32], self.pieces[key & 0xFFFFFFFF], key))

    def add(self, keys: np.ndarray, changes: np.ndarray) -> None:
        count, size = self.count, self.size
        size += map(len, self.pieces[len(size) :])
        for key, c in zip(keys.tolist(), changes.tolist(), strict=True):
            if not c or size[key >> 32] + size[key & 0xFFFFFFFF] > self.longest:
                continue
            n = count.get(key, 0) + c
            if n:
                count[key] = n
                if c > 0 and n >= self.floor:
                    self.push(key, n)
            else:
                del count[key]

    def pop(self) -> int | None:
        """The pair of the greatest count, the least by left, then right piece among equals; it is counted no more."""
        while self.count:
            while self.heap:
                n, *_, key = heapq.heappop(self.heap)
                now = self.count.get(key, 0)
                if now == -n:
                    del self.count[key]
                    return key
                if self.floor <= now < -n:  # it has become rarer since
                    self.push(key, now)
            self.floor = max(1, max(self.count.values()) // 4)
            for key, n in self.count.items():
                if n >= self.floor:
                    self.push(key, n)
        return None


def plain(c: Connection) -> Connection:
    """c, sending small messages at once."""
    with socket.fromfd(c.fileno(), socket.AF_INET, socket.SOCK_STREAM) as s:
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return c


def lead(words: Words, others: list[Connection], n_merges: int, longest: int) -> tuple[list[tuple[str, str]], list[str]]:
    def heard(own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, values = zip(own, *(c.recv() for c in others), strict=True)
        return summed(np.concatenate(keys), np.concatenate(values)) if others else own

    def told(x: object) -> object:
        for c in others:
            c.send(x)
        return x

    alphabet, n = heard(words.characters())
    pieces = ["", *map(chr, alphabet.tolist())]
    chars = [c for c, _ in sorted(zip(pieces[1:], n.tolist(), strict=True), key=lambda x: (-x[1], x[0]))]
    counts, symbol, merges = Counts(pieces, longest), {p: s for s, p in enumerate(pieces)}, []
    counts.add(*heard(words.begin(told(alphabet))))
    while len(merges) < n_merges and (key := counts.pop()) is not None:
        a, b = key >> 32, key & 0xFFFFFFFF
        merges.append((pieces[a], pieces[b]))
        if len(merges) == n_merges:
            break
        ab = symbol.setdefault(pieces[a] + pieces[b], len(pieces))
        if ab == len(pieces):
            pieces.append(pieces[a] + pieces[b])
        keys, changes = heard(words.merge(*told((a, b, ab))))
        other = keys != key
        counts.add(keys[other], changes[other])
    told(None)
    return merges, chars


def follow(words: Words, hub: Connection) -> None:
    hub.send(words.characters())
    hub.send(words.begin(hub.recv()))
    while (merge := hub.recv()) is not None:
        hub.send(words.merge(*merge))


def learn(histogram: DataFrame, n_merges: int, longest: int = 16) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges and characters by frequency of a table (word, n); no machine holds more than its share of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = Words(batches), BarrierTaskContext.get()
        if task.partitionId():
            port, key = task.allGather("")[0].split()
            with plain(Client((task.getTaskInfos()[0].address.rpartition(":")[0], int(port)), authkey=bytes.fromhex(key))) as hub:
                follow(words, hub)
            return
        others, key = len(task.getTaskInfos()) - 1, secrets.token_bytes(16)
        with Listener(("0.0.0.0", 0), backlog=others + 1, authkey=key) as door:
            task.allGather(f"{door.address[1]} {key.hex()}")
            links = [plain(door.accept()) for _ in range(others)]
        merges, chars = lead(words, links, n_merges, longest)
        both = [*merges, *((c, None) for c in chars)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), "int32"), pa.array([a for a, _ in both], "string"), pa.array([b for _, b in both], "string")], ["at", "a", "b"])

    tasks = max(1, min(MOST_TASKS, histogram.sparkSession.sparkContext.defaultParallelism))
    rows = sorted(histogram.select("word", "n").repartition(tasks).mapInArrow(run, "at int, a string, b string", barrier=True).collect())
    return [(r["a"], r["b"]) for r in rows if r["b"] is not None], [r["a"] for r in rows if r["b"] is None]
