"""Packed rows: many fixed-width entries of one task that go to the same place travel as one row of binary columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions


def parts_for(df: DataFrame, entries: int, per_part: int = 1 << 19) -> int:
    """As many parts as shuffle partitions, and more where a part would hold over per_part entries."""
    return max(shuffle_partitions(df.sparkSession), -(-entries // per_part))


class Packer:
    """Collects columns of entries (arrays whose first axis is the entry) and gives them out by part of the key, the first column.

    thin, if given, maps the columns of a whole buffer to those that are given out.
    """

    def __init__(self, parts: int, names: list[str], most: int = 8 << 20, thin: Callable[..., list[np.ndarray]] | None = None) -> None:
        self.parts, self.names, self.most, self.thin = parts, names, most, thin
        self.held: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.bytes += sum(c.nbytes for c in columns)
        if self.bytes > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.bytes = [], 0
        if self.thin:
            columns = self.thin(*columns)
        part = ((columns[0] >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        columns = [c[order] for c in columns]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(starts[1:], len(part))
        for lo in range(0, len(starts), 16):
            a, b = starts[lo : lo + 16], ends[lo : lo + 16]
            cols = [pa.array([c[i:j].tobytes() for i, j in zip(a, b, strict=True)], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(part[a].astype(np.int32)), *cols], names=["part", *self.names])


def schema(names: list[str]) -> str:
    return "part int, " + ", ".join(f"{n} binary" for n in names)


def by_part(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartitionById(parts, F.col("part"))


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list[np.dtype]) -> list[np.ndarray]:
    """All entries of a task, by column; the parts bound their number."""
    got: list[list[bytes]] = [[] for _ in kinds]
    for b in batches:
        for i in range(len(kinds)):
            got[i] += b.column(i + 1).to_pylist()
    out = []
    for g, k in zip(got, kinds, strict=True):
        out.append(np.frombuffer(b"".join(g), k))
        g.clear()
    return out


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal neighbours."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return starts, np.append(starts[1:], len(sorted_keys))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys in rows that are sorted by them; runs may cross batches."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            continue
        k = np.stack([t.column(c).to_numpy() for c in keys])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        starts = [0, *cut.tolist()]
        for a, z in zip(starts, starts[1:], strict=False):
            yield t.slice(a, z - a)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest
