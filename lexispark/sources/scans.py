"""Scans: lines of JSON, directories of them, blank-line-separated text, vocabularies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, truthy_field, usable_string

FIELDS = ("tk_source",)
EXCLUDED = ("manifest.json", "schema.json")


def spread(df: DataFrame) -> DataFrame:
    """df on as many partitions as the cluster has cores, where its files give fewer (one large row group is one task); as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, whole: bool = False, sep: str | None = None) -> DataFrame:
    """path parts, block (where the file's split begins), at (ascending within the block) and value. Files with names that begin with _ or . are not listed."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.text(path, wholetext=whole, lineSep=sep).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("parts", F.split(F.regexp_replace("file", "^file:/*", ""), "/"))
    return rows.select("parts", "block", "at", "value")


def with_line_numbers(rows: DataFrame) -> DataFrame:
    """numbered_lines with `line`, from 0 within the file: a count for each block is read first (one row a block) and joined back."""
    blocks = rows.groupBy("parts", "block").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("parts").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    blocks = blocks.select("parts", "block", (before - F.col("_first")).alias("_shift"))
    return rows.join(blocks, ["parts", "block"]).withColumn("line", F.col("at") + F.col("_shift")).drop("_shift")


def parsed(rows: DataFrame, strict: bool = False) -> DataFrame:
    """rows with `record` (a variant, null where the line is no JSON object).

    The native parser accepts junk behind an object and refuses repeated keys; strict parses by Python's rules instead.
    """
    if not strict:
        ok = F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$")
        return rows.withColumn("record", F.when(ok, F.try_parse_json("value")))

    @F.pandas_udf("string")
    def canonical(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(line: str | None) -> str | None:
            try:
                x = json.loads(line)
            except (TypeError, ValueError):
                return None
            if not isinstance(x, dict):
                return None
            return json.dumps({k: None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v for k, v in x.items()})

        for v in values:
            yield v.map(one)

    return rows.withColumn("record", F.try_parse_json(canonical("value")))


def read_jsonl(spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ord, source) and the rejects (line_no, reason, raw). Values are kept as they are, white space and all; a falsy one is rejected.

    ord orders the file's lines; line_no counts them from 1 and costs one more pass over the lines, for rejects only.
    """
    lines = numbered_lines(spark, path)

    def judged(rows: DataFrame) -> DataFrame:
        rows = parsed(rows.withColumn("value", strip(F.col("value"))).filter("value <> ''"), strict).withColumn("ord", F.col("at"))
        v = truthy_field(F.col("record"), fields)
        return rows.withColumn("source", F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))

    good = judged(lines).filter("source is not null").select("ord", "source")
    reason = F.when(F.col("record").isNull(), "malformed").otherwise("missing field")
    bad = judged(with_line_numbers(lines)).filter("source is null")
    return good, bad.select((F.col("line") + 1).alias("line_no"), reason.alias("reason"), F.col("value").alias("raw"))


def read_fallback_jsonl(spark: SparkSession, path: str, fields: tuple[str, ...], strict: bool = False) -> DataFrame:
    """(ord, source) by the first truthy field; a truthy value that is no text, or blank text, drops the record. Values are stripped."""
    rows = parsed(numbered_lines(spark, path), strict)
    return rows.withColumn("source", usable_string(truthy_field(F.col("record"), fields))).filter("source is not null").select(F.col("at").alias("ord"), "source")


def read_directory(spark: SparkSession, path: str, fields: tuple[str, ...], json_first: bool = True, limit: int | None = None) -> DataFrame:
    """(ord, source) of all .json files (an object each) and .jsonl files below path, by path parts, then line.

    manifest.json and schema.json are left out. `limit` keeps the first so many.
    """
    one = numbered_lines(spark, path, "*.json", True, True).withColumn("grp", F.lit(0 if json_first else 1))
    many = numbered_lines(spark, path, "*.jsonl", True).withColumn("grp", F.lit(1 if json_first else 0))
    one = one.filter(~F.element_at("parts", -1).isin(*EXCLUDED))
    rows = parsed(one.unionByName(many)).withColumn("source", usable_string(truthy_field(F.col("record"), fields))).filter("source is not null")
    rows = rows.select(F.struct("grp", "parts", "block", "at").alias("ord"), "source")
    return rows.orderBy("ord").limit(limit) if limit is not None else rows


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source): blocks separated by a blank line, stripped, the empty ones dropped.

    The file is split at blank lines, so no task holds it whole; line ends of other systems are cut afterwards.
    """
    text = numbered_lines(spark, path, sep="\n\n").withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))
    return programs(text, F.col("value"), "parts", "block", "at").select(F.struct("parts", "block", "at", "ord").alias("ord"), "source")


def programs(df: DataFrame, c: Column, *keep: str) -> DataFrame:
    blocks = F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda x: x != "")
    return df.select(*keep, F.posexplode(blocks).alias("ord", "source"))


def read_vocab_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score) of a vocabulary in lines of piece, tab, score; ids are line numbers."""
    rows = with_line_numbers(numbered_lines(spark, path)).withColumn("x", F.split("value", "\t"))
    return rows.select(F.col("line").cast("int").alias("id"), F.col("x")[0].alias("piece"), F.col("x")[1].cast("float").alias("score")).filter("piece <> ''")


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id) of a file that maps names to ids."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("piece", "id"))
