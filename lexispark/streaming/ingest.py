"""Streaming ingest: JSON lines that arrive as files become distinct masked sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash, mask_literals, strip, truthy_field
from ..sources.scans import FIELDS, parsed


def source_stream(spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source, hash) of each new line's first truthy text field, masked, the first of each text."""
    rows = spark.readStream.text(path).withColumn("value", strip(F.col("value"))).filter("value <> ''")
    v = truthy_field(F.col("record"), fields)
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    out = parsed(rows).select(mask_literals(text).alias("source")).filter("source is not null")
    return out.withColumn("hash", content_hash(F.col("source"))).dropDuplicates(["hash"])


def ingest(spark: SparkSession, path: str, output: str, checkpoint: str, fields: tuple[str, ...] = FIELDS) -> StreamingQuery:
    """Writes what has arrived and ends; run again, it goes on where it stopped."""
    return source_stream(spark, path, fields).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
