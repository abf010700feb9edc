"""Exact top-k search by no-random-access aggregation (Fagin, Lotem and Naor 2003), in blocks.

A block of candidates is taken in steps of STEP rows, each with one list per dimension, sorted by component. For a query
the lists are read in step, from the end that its component's sign favours, to the depths of DEPTHS. What has been read
is summed; what has not is bounded, above by the last value read of the list and below by its farthest one. Outsiders
are those whose upper bound falls short of the k-th best score so far (of the steps before, whose final scores are
known) and of the k-th best lower bound in the step. Reading stops when few others are left; their final scores are
resolved. All queries of a block are bounded at once by matrix products; components are whole numbers, so scores below
2 ** 53 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

BLOCK = 16_384
QUERIES = 8192
STEP = 1024
FEWEST = 512  # candidates of a block, where the table would give fewer blocks than the cluster has cores
DEPTHS = (1 / 4, 1 / 2, 3 / 4, 7 / 8)


class Lists:
    """The sorted lists of a step: x (rows by dimensions), each row's place in the lists, values by place."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(x))[:, None], axis=0)
        self.values = np.take_along_axis(x, order, axis=0)


def insiders(lists: Lists, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """After each depth, which candidates of each query can still be among its k best; floor: the k-th best score so far.

    own marks the query's own row, which takes no part. Each depth reads on where the one before it stopped.
    """
    n = len(lists.x)
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    top, bottom = lists.values[-1], lists.values[0]
    alive, seen = ~own, np.zeros(own.shape)
    high = low = np.zeros(lists.x.shape, bool)
    for share in DEPTHS:
        t = int(n * share)
        if t < 1:
            continue
        more_high, more_low = (lists.place >= n - t) & ~high, (lists.place < t) & ~low
        seen += up @ (lists.x * more_high).T + down @ (lists.x * more_low).T
        high, low = high | more_high, low | more_low
        upper = seen + (up * lists.values[n - t]) @ (~high).T + (down * lists.values[t - 1]) @ (~low).T
        lower = seen + (up * bottom) @ (~high).T + (down * top) @ (~low).T
        lower[own] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        alive &= upper >= np.maximum(kth, floor)[:, None]
        yield alive
        if alive.sum() <= 2 * k * len(q):
            return


def nra(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(place of the query, candidate's id, its row, score) of each query's k best in the block, ties to the smaller id."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in q]
    floor = np.full(len(q), -np.inf)
    for a in range(0, len(x), STEP):
        lists, i, r = Lists(x[a : a + STEP]), ids[a : a + STEP], rows[a : a + STEP]
        own = q_rows[:, None] == r[None, :]
        alive = ~own
        for alive in insiders(lists, q, own, floor, k):  # noqa: B007
            pass
        for j in np.flatnonzero(alive.any(axis=1)):
            rest = np.flatnonzero(alive[j])
            s = lists.x[rest] @ q[j]
            best[j] = sorted([*best[j], *zip((-s).tolist(), i[rest].tolist(), r[rest].tolist(), strict=True)])[:k]
            if len(best[j]) == k:
                floor[j] = -best[j][-1][0]
    return [(j, c, row, int(-s)) for j, found in enumerate(best) for s, c, row in found]


def whole_components(vectors: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """vec_id, x: floor(256 * component) as whole numbers, of rows whose vector and components are present and finite."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & F.col(vector_id).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(fine).select(F.col(vector_id).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("x"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows padded with zeros: a component that is missing adds nothing to a score."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by `every`) against all rows in blocks.

    Blocks of queries meet each block of candidates; the k best of each meeting are merged. Rows that repeat an id are
    rows of their own: each is a query and a candidate of the others, and only a query's own row takes no part. A vector
    that is null, or holds null or components that are not finite, takes no part. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(whole_components(vectors, vector_id, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    blocks = max(-(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // FEWEST)), 1)
    groups = -(-n // (every * QUERIES)) or 1
    found = rows.withColumn("b", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))).withColumn("is_query", F.lit(False)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("g", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).withColumn("is_query", F.lit(True))
    both = found.select("b", "g", "is_query", "vec_id", "row", "x").unionByName(asked.select("b", "g", "is_query", "vec_id", "row", "x"))
    names = ["query_row", "query_id", "vec_id", "row", "score"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["is_query"]], pdf[~pdf["is_query"]].sort_values("row")
        out: list[tuple[int, ...]] = []
        if len(ask) and len(have):
            width = max(len(v) for v in pdf["x"])
            x, q = matrix(have["x"], width), matrix(ask["x"], width)
            ids, rows_, q_rows, q_ids = (c.to_numpy() for c in (have["vec_id"], have["row"], ask["row"], ask["vec_id"]))
            for a in range(0, len(q), 256):
                out += [(q_rows[a + j], q_ids[a + j], c, r, s) for j, c, r, s in nra(x, ids, rows_, q[a : a + 256], q_rows[a : a + 256], k)]
        return pd.DataFrame(out, columns=names).astype("int64")

    part = both.groupBy("b", "g").applyInPandas(search, ", ".join(f"{c} bigint" for c in names))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
