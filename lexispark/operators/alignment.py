"""Overlap of two vocabularies, per-sample comparison of two encoders, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview, ratio


def vocab_overlap(own: DataFrame, base: DataFrame) -> DataFrame:
    """own_size, base_size, shared, union_size, novel, jaccard, overlap_pct, novel_pct of two tables with column piece."""
    a = own.select("piece").filter("piece <> ''").distinct().withColumn("a", F.lit(1))
    b = base.select("piece").filter("piece <> ''").distinct().withColumn("b", F.lit(1))
    n = a.join(b, "piece", "full").agg(F.count("a").alias("own_size"), F.count("b").alias("base_size"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count("*").alias("union_size"))
    n = n.withColumn("novel", F.col("own_size") - F.col("shared"))
    part = lambda x, y: F.coalesce(ratio(F.col(x), F.col(y)), F.lit(0.0))
    return n.withColumns({"jaccard": part("shared", "union_size"), "overlap_pct": part("shared", "own_size") * 100, "novel_pct": part("novel", "own_size") * 100})


def novel_pieces(own: DataFrame, base: DataFrame, limit: int | None = 200) -> DataFrame:
    """Pieces of own that base lacks, in code point order."""
    novel = own.select("piece").filter("piece <> ''").distinct().join(base.select("piece"), "piece", "left_anti").orderBy("piece")
    return novel if limit is None else novel.limit(limit)


def compare(df: DataFrame, own: str, base: str, source: str = "source", index: str = "ord") -> DataFrame:
    """Per sample: token counts, ratio base / own (0 without own tokens), shared and exclusive distinct pieces, a preview."""
    rows = df.select(
        F.col(index).alias("sample_index"), F.length(source).alias("source_length_chars"), F.size(own).alias("own_token_count"), F.size(base).alias("base_token_count"),
        preview(F.col(source)).alias("source_preview"), F.array_distinct(own).alias("_own"), F.array_distinct(base).alias("_base"),
    )
    rows = rows.select("*", F.size(F.array_intersect("_own", "_base")).alias("shared_unique"), F.size("_own").alias("_n_own"), F.size("_base").alias("_n_base"))
    return rows.select(
        "sample_index", "source_length_chars", "own_token_count", "base_token_count", F.coalesce(ratio(F.col("base_token_count"), F.col("own_token_count")), F.lit(0.0)).alias("ratio"), "shared_unique",
        (F.col("_n_own") - F.col("shared_unique")).alias("own_only_unique"), (F.col("_n_base") - F.col("shared_unique")).alias("base_only_unique"), "source_preview",
    )


def expansions(compared: DataFrame, least: float = 1.5) -> DataFrame:
    """Samples over the ratio, the largest first, ties by index."""
    return compared.filter(F.col("ratio") > least).orderBy(F.desc("ratio"), "sample_index").select("sample_index", "ratio", "own_token_count", "base_token_count", "source_preview")


def recommendation(overlap: DataFrame, partial: Column | bool = False) -> DataFrame:
    """action and feasibility: over 30 % novel pieces ask for an extension. partial marks a comparison with an empty foreign vocabulary."""
    extend = F.col("novel_pct") > 30
    return overlap.select("novel_pct", F.when(extend, "vocab_extension_prototype").otherwise("use_base_tokenizer_directly").alias("action"), F.when(extend, "low").otherwise("high").alias("feasibility"), (partial if isinstance(partial, Column) else F.lit(partial)).alias("partial"))


def average_ratio(compared: DataFrame) -> DataFrame:
    """The mean of the ratios over 0, unrounded; reports average rounded ones (reports.mean_rounded)."""
    return compared.agg(F.avg(F.when(F.col("ratio") > 0, F.col("ratio"))).alias("avg_ratio"))
