"""Metrics of encoded corpora, each a single aggregate; encode once, then derive all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_count, ratio

ZERO = F.lit


def p95(df: DataFrame, c: str) -> DataFrame:
    """p95: the value at index min(floor(0.95 n), n - 1) in ascending order, from a histogram of the values.

    The histogram has a row for each distinct count; only it is put in order.
    """
    from pyspark.sql import Window

    h = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("k"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("cum", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(0))))
    index = F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1)
    return h.filter(F.col("cum") > index).agg(F.coalesce(F.min("v"), F.lit(0)).cast("double").alias("p95"))


def token_stats(df: DataFrame, pieces: str) -> DataFrame:
    """mean, median, p95 of tokens per row; zeros for an empty table."""
    counts = df.select(F.size(pieces).alias("v"))
    main = counts.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.median("v"), F.lit(0.0)).alias("median"))
    return main.join(F.broadcast(p95(counts, "v")), F.lit(True))


def compression_ratio(own: Column, base: Column) -> Column:
    return F.coalesce(ratio(F.sum(own), F.sum(base)), F.lit(0.0))


def fertility(pieces: Column, text: Column) -> Column:
    """Mean over rows of tokens per character; rows without characters are left out."""
    return F.coalesce(F.avg(ratio(F.size(pieces), F.length(text))), F.lit(0.0))


def tokens_per_char(pieces: Column, text: Column) -> Column:
    return F.coalesce(ratio(F.sum(F.size(pieces)), F.sum(F.length(text))), F.lit(0.0))


char_to_token_ratio = tokens_per_char


def chars_per_token(pieces: Column, text: Column) -> Column:
    return F.coalesce(F.avg(ratio(F.length(text), F.size(pieces))), F.lit(0.0))


def tokens_per_line_macro(pieces: Column, text: Column) -> Column:
    return F.coalesce(F.avg(ratio(F.size(pieces), line_count(text))), F.lit(0.0))


def distinct_pieces(df: DataFrame, pieces: str) -> DataFrame:
    return df.select(F.explode(pieces).alias("piece")).distinct()


def vocab_utilization(df: DataFrame, pieces: str, vocab_size: int) -> DataFrame:
    used = distinct_pieces(df, pieces).agg(F.count("*").alias("used"))
    return used.select("used", F.coalesce(ratio(F.col("used"), F.lit(vocab_size)), F.lit(0.0)).alias("vocab_utilization"))


def coverage_percent(ids: Column, unknown: int) -> Column:
    """100 * (1 - unknown / all); 100 where there are no tokens."""
    miss = F.size(F.filter(ids, lambda x: x == unknown))
    return F.coalesce(F.lit(100.0) * (F.lit(1.0) - ratio(F.sum(miss), F.sum(F.size(ids)))), F.lit(100.0))


def corpus_chars(text: Column) -> Column:
    """Characters of the written text: records, blank lines between, one newline."""
    n = F.count("*")
    return F.coalesce(F.sum(F.length(text)), F.lit(0)) + F.when(n > 0, 2 * (n - 1)).otherwise(0) + 1


def roundtrip(ok: Column) -> list[Column]:
    return [F.count_if(ok).alias("passed"), F.count("*").alias("total")]
