"""Toxicity: FTRL-proximal logistic regression (McMahan et al. 2013) over hashed word n-grams and skip-grams.

Words are the runs of letters, digits and bytes beyond ASCII in the lower-cased text. Features are the distinct hashed
words, pairs of neighbours and pairs with one word between, each with value 1. Every coordinate has its own learning
rate; the L1 term leaves few weights, and those are broadcast (at most 2 ** BITS of them, whatever the corpus). The
classifier is fitted on at most MOST_ROWS labelled rows, those of the least hash of doc_id; scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import mix64, small_batches, written

BITS = 20
MOST_ROWS = 6000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
STEPS = 24_000
LEAST_ROWS = 5  # a feature of fewer labelled rows gets no weight
POSITIVE = 3.0  # times that a toxic row counts

KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct feature numbers of a text, ascending."""
    words = (text or "").encode().translate(KEEP).split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    grams = np.concatenate([w, mix64(w[:-1] * a + w[1:]), mix64(w[:-2] * b + w[2:])])
    return np.unique((grams >> np.uint64(64 - BITS)).astype(np.int32))


class Labelled(NamedTuple):
    """Labelled rows with the features that enough rows have, flat: row k holds x[at[k] : at[k + 1]], places in `features`."""

    features: np.ndarray
    x: np.ndarray
    at: np.ndarray
    y: np.ndarray


def fit(rows: Labelled, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, weights) of the nonzero weights; number 2 ** BITS is the bias, which has no L1 term."""
    size = len(rows.features) + 1
    z, n = np.zeros(size), np.zeros(size)
    epochs = int(np.clip(steps // max(1, len(rows.y)), 2, 25))
    order = np.random.RandomState(7)
    l1 = np.full(size, L1)
    l1[-1] = 0.0

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1[i], 0.0, w)

    for _ in range(epochs):
        for k in order.permutation(len(rows.y)):
            i = np.append(rows.x[rows.at[k] : rows.at[k + 1]], size - 1)
            y = rows.y[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g *= POSITIVE if y else 1.0
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(slice(None))
    keep = np.flatnonzero(w)
    return np.append(rows.features, 1 << BITS)[keep].astype(np.int32), w[keep].astype(np.float32)


def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Labelled:
    """At most `most` labelled rows outside the held-out fold; a doc_id with several labels takes the largest.

    Rows of a feature are counted in Spark, and only features of LEAST_ROWS rows or more are sent, as Arrow batches: the
    driver holds one flat array of at most `most` rows' frequent features (more only where doc_ids repeat).
    """
    y = labels.filter("doc_id is not null and toxic is not null and pmod(crc32(cast(cast(doc_id as bigint) as string)), 5) <> 0").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    x = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(y), "doc_id").select("doc_id", "text", "toxic")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = [features(t, hashes) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32())), b.column(2)], names=["doc_id", "x", "toxic"])

    small_batches(documents.sparkSession)
    kept = written(x.mapInArrow(extract, "doc_id bigint, x array<int>, toxic int"), "labelled")
    often = kept.select(F.explode("x").alias("f")).groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS).select("f")
    known = np.sort(often.toArrow().column("f").to_numpy())  # at most 2 ** BITS

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1)
            flat, ends = x.flatten().to_numpy(), np.cumsum(x.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            ends = np.append(0, np.append(0, np.cumsum(hit))[ends])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[hit].astype(np.int32))), b.column(2)], names=["doc_id", "x", "toxic"])

    t = kept.orderBy("doc_id", "x").mapInArrow(frequent, "doc_id bigint, x array<int>, toxic int").toArrow()
    lists = t.column("x").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *lists.chunks])
    return Labelled(known, lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int64), t.column("toxic").to_numpy())


def scored(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], score_as: str = "_score") -> DataFrame:
    """documents with a column score_as. Null and empty texts score by the bias alone."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model[0], model[1]))
    small_batches(spark)
    at = documents.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[shared.value[0]] = shared.value[1]
        for b in batches:
            s = [1 / (1 + np.exp(-np.clip(float(w[features(t, hashes)].sum(dtype=np.float64)) + float(w[-1]), -35, 35))) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, score_as])

    return documents.mapInArrow(score, StructType([*documents.schema.fields, StructField(score_as, DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Without labelled rows of the other folds every score is 0.5 and predicted 1."""
    model = fit(labelled(documents, labels))
    out = scored(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), model)
    return out.select("doc_id", F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
