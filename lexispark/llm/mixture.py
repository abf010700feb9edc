"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents in a pseudorandom order, are packed into blocks of a fixed number of words; the
last block holds the rest. Every source gets as many output slots as its target in whole words takes: all blocks for each
epoch the target fills, then blocks until the target is met, the last one drawn cut to the words still missing. So a
source's words are its target, rounded, whatever its size. The slots of a source fall to output shards independently, so a shard's
counts by source are multinomial, given that each source meets its target; a slot is mapped to a block by a pseudorandom
permutation of the source's block indices (swap-or-not, Hoang, Morris and Rogaway 2012), a new one for each epoch, and
blocks are joined by index. A block is taken at most once per epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shuffle_partitions, with_key, written

BLOCK = 128
SHARDS = 64
ROWS_PER_BUCKET = 512
BUCKETS_PER_PAGE = 4096
PIECE = 10_000
ROUNDS = 24
SHARE = 1.5
CAP = 2
SEED = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """x's image under a pseudorandom permutation of 0 .. n-1; every round is a swap-or-not, an involution on the range.

    back gives the inverse: the same rounds from the last to the first.
    """

    def step(v: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r, F.lit(SEED)), n) - v, n)
        bit = F.xxhash64(*key, r, F.greatest(v, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(v)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, x, step)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of each source: weights 5, 2, 1 repeating in code point order, null last.

    Targets share SHARE of all words by weight; a target stops at CAP times its source's size and the excess is shared
    again. With limits l and weights w, the sources that stop are those of least l / w; so one sort and running sums
    give the level. One row per source is windowed.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("int")))
    s = s.withColumn("l", F.col("source_size") * float(CAP)).withColumn("q", F.col("l") / F.col("w"))
    by = Window.orderBy("q", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * SHARE
    # the level if exactly the sources before this one stop
    level = (total - F.coalesce(F.sum("l").over(before), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    s = s.withColumn("water", F.max(F.when(F.col("level") <= F.col("q"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least("l", F.coalesce(F.col("water") * F.col("w"), F.col("l"))).alias("target"))


def before_bucket(sums: DataFrame) -> DataFrame:
    """sums (source, bucket, _s) with base, the sum of the source's buckets before each, in two levels: no task orders all buckets of a source."""
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("page", F.floor(F.col("bucket") / BUCKETS_PER_PAGE))
    pages = sums.groupBy("source", "page").agg(F.sum("_s").alias("_p")).select(F.col("source").alias("_ps"), F.col("page").alias("_pp"), (F.sum("_p").over(upto("source", "page")) - F.col("_p")).alias("_before"))
    inside = sums.withColumn("_in", F.sum("_s").over(upto("source", "page", "bucket")) - F.col("_s"))
    return inside.join(pages, inside["source"].eqNullSafe(pages["_ps"]) & (inside["page"] == pages["_pp"])).select("source", "bucket", (F.col("_before") + F.col("_in")).alias("base"))


class Mixture:
    """docs: (key, place, source, size) of every row: key is unique, place a hash that reruns agree on and that orders a source."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> None:
        self.block, self.shards = block, shards
        s = targets(docs).withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("bigint")).withColumn("words", F.round("target").cast("bigint"))
        # whole epochs, the words of the epoch after them, and the place of the last, short block in that epoch
        s = s.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
        s = s.withColumn("rest", F.col("words") - F.col("full") * F.col("source_size")).withColumn("missing", F.col("n_blocks") * block - F.col("source_size"))
        s = s.withColumn("short_at", F.when(F.col("rest") > 0, permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.xxhash64("source"), F.col("full"), back=True)))
        last = F.when(F.col("rest") > 0, F.ceil((F.col("rest") + F.when(F.col("rest") > F.col("short_at") * block, F.col("missing")).otherwise(F.lit(0))) / block)).otherwise(F.lit(0)).cast("bigint")
        self.sources = written(s.withColumn("slots", F.col("full") * F.col("n_blocks") + last), "mix-sources")
        counted = docs.filter("size > 0").withColumn("bucket", F.xxhash64("place", F.lit(SEED)))
        n = written(docs.filter("size > 0").groupBy("source").agg(F.ceil(F.count("*") / ROWS_PER_BUCKET).cast("bigint").alias("buckets")), "mix-buckets")
        same = lambda a, b: a["source"].eqNullSafe(b["source"])
        counted = counted.join(n, same(counted, n)).select("key", "place", counted["source"], "size", F.pmod("bucket", F.col("buckets")).alias("bucket"))
        base = before_bucket(counted.groupBy("source", "bucket").agg(F.sum("size").alias("_s"))).select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "base")
        inner = Window.partitionBy("source", "bucket").orderBy("place", "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = counted.withColumn("upto", F.sum("size").over(inner))
        placed = within.join(base, within["source"].eqNullSafe(base["_source"]) & (within["bucket"] == base["_bucket"])).select("key", "source", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
        placed = placed.withColumn("first", F.floor(F.col("start") / block)).withColumn("last", F.floor((F.col("start") + F.col("size") - 1) / block))
        placed = written(placed, "mix-placed")
        self.placed = placed

    def ranges(self, rows: DataFrame, first: Column, end: Column, *held: str) -> DataFrame:
        """The numbers first .. end-1 of each row as `slot`, made from pieces of at most PIECE on all partitions."""
        pieces = rows.filter(end > first).select("source", *held, first.alias("_f"), end.alias("_e"), F.explode(F.sequence(F.lit(0), F.floor((end - first - 1) / PIECE))).alias("_piece"))
        pieces = pieces.repartition(shuffle_partitions(rows.sparkSession), "source", "_f", "_piece")
        at = F.col("_f") + F.col("_piece") * PIECE
        return pieces.select("source", *held, F.explode(F.sequence(at, F.least(F.col("_e"), at + PIECE) - 1)).alias("slot"))

    def shard_counts(self) -> DataFrame:
        """source, shard, drawn, first: a multinomial draw of each source's slots over the shards, and the slots before the shard's."""
        draw = F.pmod(F.xxhash64(F.lit("shard"), "source", "slot", F.lit(SEED)), F.lit(self.shards)).cast("int")
        counts = self.ranges(self.sources, F.lit(0).cast("bigint"), F.col("slots")).groupBy("source", draw.alias("shard")).agg(F.count("*").alias("drawn"))
        upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most `shards` rows each
        return counts.withColumn("first", F.sum("drawn").over(upto) - F.col("drawn"))

    def slots(self) -> DataFrame:
        """Every output slot: source, shard, slot, epoch, block index, words it may take."""
        held = ["n_blocks", "full", "rest", "missing", "short_at"]
        counts = self.shard_counts()
        s = self.sources.select(F.col("source").alias("_source"), *held)
        s = counts.join(s, counts["source"].eqNullSafe(s["_source"]))
        s = self.ranges(s, F.col("first"), F.col("first") + F.col("drawn"), "shard", *held)
        s = s.withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks")))
        x = F.pmod("slot", F.col("n_blocks"))
        before = x * self.block - F.when(x > F.col("short_at"), F.col("missing")).otherwise(F.lit(0))
        words = F.when(F.col("epoch") < F.col("full"), F.lit(self.block)).otherwise(F.least(F.lit(self.block), F.col("rest") - before))
        return s.select("source", "shard", "slot", "epoch", permuted(x, F.col("n_blocks"), F.xxhash64("source"), F.col("epoch")).alias("block"), words.alias("words"))

    def drawn(self) -> DataFrame:
        """key, shard, slot, epoch, begin, end: the words begin .. end-1 of a document that a slot takes."""
        parts = self.placed.select("key", "source", "size", "start", F.explode(F.sequence("first", "last")).alias("block"))
        parts = parts.select(
            "key", "start", F.xxhash64("source").alias("s"), F.col("source").alias("_source"), F.col("block").alias("_block"),
            F.greatest(F.lit(0), F.col("block") * self.block - F.col("start")).alias("begin"), F.least(F.col("size"), (F.col("block") + 1) * self.block - F.col("start")).alias("end"),
        )
        slots = self.slots().withColumn("t", F.xxhash64("source"))
        # the slots grow with the corpus though their pieces look small: sort-merge, no broadcast
        both = parts.join(slots.hint("merge"), (parts["s"] == slots["t"]) & (parts["_block"] == slots["block"]) & parts["_source"].eqNullSafe(slots["source"]))
        end = F.least(F.col("end"), F.col("block") * self.block + F.col("words") - F.col("start"))
        return both.select("key", "shard", "slot", "epoch", "begin", end.alias("end")).filter("begin < end")


def measured(documents: DataFrame, key: Column) -> DataFrame:
    """key, place, doc_id, source, size of every row; rows without a doc_id are placed by their text."""
    place = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")), F.lit(SEED))
    return documents.select(key.alias("key"), place.alias("place"), F.col("doc_id").cast("bigint"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))


def mixed(documents: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row. Documents without words take part with 0 words.

    Rows that repeat a doc_id are told apart by their place in the input. An empty table gives no rows.
    """
    docs = written(measured(documents, F.monotonically_increasing_id()), "mix-docs")
    m = Mixture(docs, block, shards)
    taken = m.drawn().groupBy("key").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    s = m.sources.select(F.col("source").alias("_source"), "source_size", "target")
    out = docs.join(taken, "key", "left")
    out = out.join(s, out["source"].eqNullSafe(s["_source"]))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(documents: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mix as documents: for each document and epoch, a row whose text is the words drawn, in their order.

    White space behind a word stays with it, so a document drawn whole keeps its text as it is; n_chars is renewed.
    Documents without words are not drawn. An empty table gives no rows; rows that repeat a doc_id are drawn one by one.
    """
    rows, key, _ = with_key(documents)
    parts_, whole, words = (f"{key}_{x}" for x in ("parts", "whole", "words"))
    docs = written(measured(rows, F.col(key)), "mix-docs")
    parts = Mixture(docs, block, shards).drawn().groupBy("key", "epoch").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("parts"), F.sum(F.col("end") - F.col("begin")).alias("taken"))
    parts = parts.join(docs.select("key", "size"), "key").select(F.col("key").alias(key), (F.col("taken") == F.col("size")).alias(whole), F.col("parts").alias(parts_))
    split = F.regexp_extract_all("text", F.lit(r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    some = F.expr(f"array_join(flatten(transform(`{parts_}`, p -> slice(`{words}`, cast(p.begin as int) + 1, cast(p.end - p.begin as int)))), '')")
    out = rows.join(parts, key).withColumn(words, F.when(~F.col(whole), split)).withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(some))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
