"""Operators as stages over documents: each returns documents with the columns it was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, toxicity
from .common import fits_broadcast, fresh, with_key, written


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more, each row by its own text; all rows where there are no labels to learn from."""
    model = toxicity.fit(toxicity.labelled(docs, labels))
    if not len(model[0]):
        return docs
    score = fresh(docs, "score")
    return toxicity.scored(docs, model, score).filter(F.col(score) < 0.5).drop(score)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of linked documents, that of the least doc_id (null last); rows without words all stay.

    Rows that share a doc_id, or have none, are judged one by one, so a row repeated whole stays once.
    """
    rows, key, by_id = with_key(docs)
    found = jaccard.similar_documents(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("k"), F.col("component_id").alias("c"))
    if by_id:
        gone = found.filter("c <> k")
    else:
        found = written(found.join(rows.select(F.col(key).alias("k"), F.col("doc_id").cast("bigint").alias("d")), "k"), "components")
        first = found.groupBy("c").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "k")).alias("first"))
        gone = found.join(first, "c").filter("k <> first.k")
    gone = written(gone.select(F.col("k").alias(key)), "gone")
    return rows.join(F.broadcast(gone) if fits_broadcast(gone, 40) else gone, key, "left_anti").select(*docs.columns)
