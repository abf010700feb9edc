"""Required patterns as single tokens, vocabulary search, syntax counts and the verdict on retraining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import substring_count

# fixed values: the pattern catalogue, the required single tokens, the search terms and the counted patterns
CATALOGUE = {
    "type_sigils": ["$i64", "$str", "$bool", "$f64", "$u64", "$i32", "$u32", "$mytype"],
    "array_map_open": ["@("],
    "declaration_keywords": ["m=", "f=", "i=", "t="],
    "operators": ["&&", "||", "!=", ">=", "<="],
    "indexing": [".get(", ".len"],
    "old_syntax_keywords": ["M=", "F=", "T=", "I="],
    "old_syntax_types": ["i64", "f64", "Str", "bool", "u64", ":i64", ":f64", ":Str"],
}
REQUIRED = ["$i64", "$f64", "$str", "$bool", "$u64", "$byte", "@(", "m=", "f=", "t=", "i=", ".get(", "&&", "||"]
TERMS = ["$", "@(", "m=", "f=", "i=", "t=", "M=", "F=", "T=", "I=", "i64", "f64", "u64", "bool", "Str", "str", ".get", ".len", "&&", "||", "mut", "lp(", "el{", "br"]
COUNTED = ["$", "@(", "m=", "f=", "M=", "F=", "T=", "I="]
NEW = ["type_sigils", "array_map_open", "declaration_keywords"]
OLD = ["old_syntax_keywords", "old_syntax_types"]
NEW_COUNTED, OLD_COUNTED = ["$", "@("], ["M=", "F=", "T="]


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(c, i, p) for c, ps in CATALOGUE.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "category string, pos int, pattern string")


def required(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REQUIRED)), "pos int, pattern string")


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


def single_tokens(patterns: DataFrame, pieces: Column) -> DataFrame:
    """patterns with pieces, num_pieces and is_single_token."""
    p = patterns.withColumn("pieces", pieces)
    return p.withColumn("num_pieces", F.size("pieces")).withColumn("is_single_token", F.col("num_pieces") == 1)


def missing(checked: DataFrame) -> DataFrame:
    return checked.filter(~F.col("is_single_token")).orderBy("pos").select("pattern")


def rates(checked: DataFrame) -> DataFrame:
    """new_single, new_total, old_single, old_total over the categories of new and old syntax, and needs_retraining."""
    count = lambda cats, single: F.count_if(F.col("category").isin(cats) & (F.col("is_single_token") if single else F.lit(True)))
    r = checked.agg(count(NEW, True).alias("new_single"), count(NEW, False).alias("new_total"), count(OLD, True).alias("old_single"), count(OLD, False).alias("old_total"))
    return r.withColumn("needs_retraining", F.col("new_single") < F.col("new_total") * 0.5)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Patterns whose single-token state differs between two encoders."""
    o, n = old.select("pattern", F.col("is_single_token").alias("old_single")), new.select("pattern", F.col("is_single_token").alias("new_single"))
    return o.join(n, "pattern").withColumn("changed", F.col("old_single") != F.col("new_single"))


def looked_up(wanted: DataFrame, checked: DataFrame) -> DataFrame:
    """wanted with the results of its patterns; a pattern that was not checked is no single token. Both are short fixed lists."""
    found = checked.select("pattern", "num_pieces", "is_single_token").dropDuplicates(["pattern"])
    return wanted.join(F.broadcast(found), "pattern", "left").withColumn("is_single_token", F.coalesce("is_single_token", F.lit(False)))


def vocab_search(vocab: DataFrame, terms_: DataFrame, first_id: int = 0) -> DataFrame:
    """term, hits, first_id, entries (id, piece) of the pieces that contain a term; terms without hits are absent.

    terms is a short fixed list, so it is broadcast.
    """
    hit = vocab.filter(F.col("id") >= first_id).join(F.broadcast(terms_), F.contains(F.col("piece"), F.col("term")))
    return hit.groupBy("term").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"), F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("entries"))


def syntax_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """One row: a count for each counted pattern, the characters of the text, and the flags uses_new and uses_old."""
    c = F.col(source)
    return flagged(df.select(*(substring_count(c, p).alias(f"n_{i}") for i, p in enumerate(COUNTED)), F.length(c).alias("chars")))


def file_syntax_counts(spark: SparkSession, path: str) -> DataFrame:
    """The same for plain text files, read by line, so that no task holds a file: no counted pattern goes beyond a line.

    The reader drops newlines and a byte order mark; a file's size tells the mark and whether its last line ends.
    """
    c, lines = F.col("value"), spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    names = [f"n_{i}" for i in range(len(COUNTED))]
    files = lines.groupBy("file", "size").agg(*(F.sum(substring_count(c, p)).alias(n) for n, p in zip(names, COUNTED, strict=True)), F.sum(F.length(c)).alias("_chars"), F.sum(F.octet_length(c)).alias("_bytes"), F.count("*").alias("_lines"))
    left = F.col("size") - F.col("_bytes") - F.col("_lines")  # -1: the last line is open; 3 more: a mark, which is one character
    dropped = F.when(left == -1, -1).when(left == 3, 1).otherwise(0)
    return flagged(files.select(*names, (F.col("_chars") + F.col("_lines") + dropped).alias("chars")))


def flagged(counts: DataFrame) -> DataFrame:
    row = counts.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts.columns))
    some = lambda ps: sum((F.col(f"n_{COUNTED.index(p)}") for p in ps), F.lit(0)) > 0
    return row.withColumn("uses_new", some(NEW_COUNTED)).withColumn("uses_old", some(OLD_COUNTED))


def reason(uses_new: Column, needs: Column) -> Column:
    """Three-valued: an unknown use of the new syntax is no evidence against the training text."""
    return F.when(uses_new.eqNullSafe(F.lit(False)), "trained on old syntax: retrain").when(needs, "under half of the new patterns are single tokens: retrain").otherwise("new patterns are well represented")
