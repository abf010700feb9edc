"""Helpers shared by the operators: tables, written stages, packed rows, linked components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ONE_TASK = 1 << 21  # edges, of 16 bytes each
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the session names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")  # one machine: its own folder is shared
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes of a batch between the JVM and Python, unless the session already does: by count alone, long texts make batches of any size."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> bool:
    """Whether df (already written) stays under limit bytes when broadcast; the caller shuffles otherwise."""
    return df.count() * row_bytes <= limit


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def with_key(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a column that tells its rows apart, the column's name, and whether it is the doc_id.

    Where a doc_id is missing or repeated, rows are numbered instead, and written, so that a lost executor cannot
    renumber them.
    """
    key, doc_id = fresh(docs, "key"), F.col("doc_id").cast("bigint")
    if docs.groupBy(doc_id.alias("doc_id")).agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn(key, doc_id), key, True
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key, False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) of a task: least labels, hooked and halved until none falls."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got, strict=True) if got else ((), ())))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while len(a):
        x, y = low[a], low[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[low[i : i + 100_000]])], names=["node", "component"])


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Up to one_task edges, counted first, are settled in one task of an executor. More of them go by rounds, which alternate
    large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), each written;
    rounds grow with the logarithm of the nodes. The minimum of a node's neighbours is an aggregate with map-side combine,
    and it is joined back, so that a hub's neighbours are never gathered in one task.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, name)
    if e.count() <= one_task:
        return written(e.coalesce(1).mapInArrow(settled, "node bigint, component bigint"), name)
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large-star: neighbours above u, to the minimum of u's neighbourhood
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small-star: u and its neighbours at or below, to their minimum
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        e = written(small, name)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
