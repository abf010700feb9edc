"""Sharding by minimax contiguous partition.

Equal texts are one atomic group; groups are ordered by a 64-bit hash of the text. The smallest feasible shard capacity
over the ordered group sizes is found by binary search with a greedy check, and the order is cut there. The driver holds
sums of hash ranges only: a capacity is checked once with ranges that cannot be cut and once with ranges that can be cut
anywhere; where the two disagree, the ranges that the cuts fall into are split and summed again, so a cut is exact to the
group whatever their number. Equal texts never part, so a group larger than an even share makes its shard larger.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 16  # of the hash, for the first ranges
FINER = 8  # more bits in each split


class Ranges:
    """Hash ranges in order: the first hash, bits that its hashes share, size of its groups, whether it is one group."""

    def __init__(self, first: np.ndarray, bits: np.ndarray, size: np.ndarray, single: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        self.first, self.bits, self.size, self.single = first[order], bits[order], size[order], single[order]
        self.upto = np.cumsum(self.size)

    def cuts(self, capacity: int, shards: int, divisible: bool) -> tuple[bool, list[int]]:
        """Whether greedy shards hold all, and the range behind each full shard; divisible: ranges of several groups can be cut anywhere."""
        total, at, met = int(self.upto[-1]), 0, []
        for _ in range(shards):
            i = int(np.searchsorted(self.upto, at + capacity, side="right"))
            if i == len(self.size):
                return True, met
            met.append(i)
            end = at + capacity if divisible and not self.single[i] else int(self.upto[i] - self.size[i])
            if end <= at:
                return False, met
            at = end
        return at == total, met

    def split(self, places: list[int], finer: Ranges) -> Ranges:
        keep = np.ones(len(self.size), bool)
        keep[places] = False
        both = lambda name: np.concatenate([getattr(self, name)[keep], getattr(finer, name)])
        return Ranges(both("first"), both("bits"), both("size"), both("single"))


def minimax_cuts(ranges: Ranges, largest: int, shards: int, summed: Callable[[np.ndarray, np.ndarray], Ranges]) -> tuple[int, list[int]]:
    """(least capacity, first hash of each shard but the first) of contiguous shards; `summed` splits ranges (first, bits)."""
    total = int(ranges.upto[-1])
    low, high = max(largest, -(-total // shards)), total
    while True:
        middle = (low + high) // 2
        fits, behind = ranges.cuts(middle, shards, divisible=False)
        if fits:
            if low == high:
                return high, ranges.first[behind].tolist()
            high = middle
            continue
        may, beyond = ranges.cuts(middle, shards, divisible=True)
        if not may:
            low = middle + 1
            continue
        open_ = [i for i in sorted({*behind, *beyond}) if not ranges.single[i]]
        ranges = ranges.split(open_, summed(ranges.first[open_], ranges.bits[open_]))


def sums_of(groups: DataFrame) -> Callable[[np.ndarray, np.ndarray], Ranges]:
    """Splits ranges by FINER more bits: sums over the groups (h, size) in them, at most 2 ** FINER rows for each range."""
    spark = groups.sparkSession

    def summed(first: np.ndarray, bits: np.ndarray) -> Ranges:
        parts = []
        for b in np.unique(bits):
            some = F.broadcast(spark.createDataFrame([(int(x) >> int(64 - b),) for x in first[bits == b]], "_range bigint"))
            inside = groups.join(some, F.shiftright("h", int(64 - b)) == F.col("_range"))
            parts.append(collected(inside, min(64, int(b) + FINER)))
        return Ranges(*(np.concatenate(c) for c in zip(*((p.first, p.bits, p.size, p.single) for p in parts), strict=True)))

    return summed


def collected(groups: DataFrame, bits: int) -> Ranges:
    """The sums by the first `bits` bits of the hash: at most 2 ** BITS rows the first time, few ranges' worth after it."""
    t = groups.groupBy(F.shiftright("h", 64 - bits).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).toArrow()
    p = t.column("p").to_numpy()
    return Ranges(p << np.int64(64 - bits), np.full(len(p), bits), t.column("size").to_numpy(), (t.column("n").to_numpy() == 1) | (bits == 64))


def sharded(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, law "bytes", shard, slot (gapless in a shard from 0), grown_shard (null).

    A null text is a group of its own (size 8, crc32 of no bytes). Repeated rows each get a slot. Slots follow the texts'
    hashes, then a hash of doc_id; they come from counts by range partition, so no shard or group is gathered in one
    task. An empty table gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(F.col("doc_id").cast("bigint"), (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(F.col("text").isNull(), F.coalesce("text", F.lit(""))).alias("h"))
    order = ("h", F.xxhash64("doc_id"), "doc_id")
    rows = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shard-rows")
    groups = written(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    largest = groups.agg(F.max("size")).first()[0]
    firsts = minimax_cuts(collected(groups, BITS), largest, shards, sums_of(groups))[1] if largest else []
    cut = F.array(*(F.lit(int(e)) for e in firsts)).cast("array<bigint>")
    rows = rows.withColumn("shard", F.size(F.filter(cut, lambda e: e <= F.col("h"))))
    # a partition's rows of one shard are neighbours in it: their slots follow those of the partitions before
    runs = rows.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select("shard", "part", (F.sum("n").over(w) - F.col("n") - F.col("start")).alias("shift"))
    return rows.join(runs, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
