"""Exact deduplication, splits and samples over (ord, source)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def dedup_first(df: DataFrame, source: str = "source", ord_: str = "ord") -> DataFrame:
    """The first row of each text. Rows of a text are combined before the shuffle, so copies do not skew it."""
    rest = F.struct(*df.columns)
    return df.groupBy(content_hash(F.col(source)).alias("_h")).agg(F.min_by(rest, ord_).alias("_r")).select("_r.*")


def dedup_counts(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(content_hash(F.col(source)).alias("h")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed")
    )


def hash_key(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def split_by_hash(df: DataFrame, fraction: float, seed: int = 42, key: str = "ord") -> DataFrame:
    """df with split: "train" for the floor(n * fraction) rows of least hash, else "valid".

    The cut is found without a global ranking: rows are counted by the hash's first 16 bits, and only the bin that holds
    the cut is ordered.
    """
    h = hash_key(seed, F.col(key))
    rows = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = {r["_b"]: r["count"] for r in rows.groupBy("_b").count().collect()}  # at most 65,536 rows
    want = int(sum(counts.values()) * fraction)
    below, cut = 0, 0
    for b in sorted(counts):
        if below + counts[b] > want:
            cut = b
            break
        below += counts[b]
        cut = b + 1
    inside = want - below
    edge = [r[0] for r in rows.filter(F.col("_b") == cut).select("_h").orderBy("_h").limit(inside).collect()] if inside > 0 else []
    last = edge[-1] if edge else ""
    train = (F.col("_b") < cut) | ((F.col("_b") == cut) & (F.col("_h") <= F.lit(last)))
    return rows.withColumn("split", F.when(train, "train").otherwise("valid")).drop("_h", "_b")


def split_exact(df: DataFrame, fraction: float, seed: int = 42, ord_: str = "ord") -> DataFrame:
    """df with split and pos, by the permutation that Python's seeded shuffle gives to n positions.

    The permutation depends on n and the seed alone; it is drawn on the driver, so this mode is for corpora whose row
    numbers fit there. split_by_hash is the one for any size.
    """
    numbered = with_positions(df, ord_)
    n = numbered.count()
    order = list(range(n))
    random.Random(seed).shuffle(order)
    cut = int(n * fraction)
    cut = max(0, n + cut) if cut < 0 else min(cut, n)
    places = df.sparkSession.createDataFrame([(p, i, "train" if i < cut else "valid") for i, p in enumerate(order)], "_n bigint, pos bigint, split string")
    return numbered.join(places, "_n").drop("_n")


def sample_exact(df: DataFrame, k: int, seed: int = 42, ord_: str = "ord") -> DataFrame:
    """min(k, n) rows in the order that Python's seeded sample draws positions; pos is the draw."""
    numbered = with_positions(df, ord_)
    n = numbered.count()
    drawn = random.Random(seed).sample(range(n), min(k, n))
    places = df.sparkSession.createDataFrame(list(enumerate(drawn)), "pos bigint, _n bigint")
    return numbered.join(F.broadcast(places), "_n").drop("_n")


def with_positions(df: DataFrame, ord_: str = "ord") -> DataFrame:
    """df with _n, gapless from 0 in the order of ord_, by counts of range partitions.

    The rows stay persisted while the result is in use; Spark drops them with the session or under memory pressure.
    """
    rows = df.repartitionByRange(ord_).sortWithinPartitions(ord_).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    counts = sorted((r["_p"], r["count"]) for r in rows.groupBy("_p").count().collect())  # a row for each partition
    before, base = 0, []
    for p, c in counts:
        base.append((p, before))
        before += c
    shift = df.sparkSession.createDataFrame(base, "_p int, _b bigint")
    return rows.join(F.broadcast(shift), "_p").withColumn("_n", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def sample_by_hash(df: DataFrame, k: int, seed: int = 42, key: str = "ord") -> DataFrame:
    """The k rows of least hash."""
    return df.orderBy(hash_key(seed, F.col(key)), key).limit(k)


def head(df: DataFrame, n: int = 200, ord_: str = "ord") -> DataFrame:
    return df.orderBy(ord_).limit(n)
