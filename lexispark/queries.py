"""Queries over the driver's tables for the library's own operators, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import alignment, bpe, corpus, metrics, patterns, tokenizers
from .sources import scans

QUERIES, ORACLE_SQL = {}, {}
RX = "[A-Za-z_]+|[0-9]+|[^ \\t\\r\\nA-Za-z_0-9]"
BASE = f"d AS (SELECT doc_id AS ord, text AS source, regexp_extract_all(text, '{RX}') AS rx, list_filter(string_split(text, ''), lambda x: x <> '') AS ch FROM documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("ord"), F.col("text").alias("source"))


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return scans.spread(docs(spark, d)).withColumn("rx", tokenizers.regex_pieces(F.col("source"))).withColumn("ch", tokenizers.char_pieces(F.col("source")))


def vocab(spark: SparkSession, d: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/{name}.parquet")
    return t.select(F.explode(tokenizers.regex_pieces(F.col("text"))).alias("piece")).distinct()


VOCABS = f"a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{RX}')) AS piece FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{RX}')) AS piece FROM conversations)"
MASK = "regexp_replace(source, '(?s)\"(?:[^\"\\\\]|\\\\.)*\\\\?(\"?)', '\"<STR>\\1', 'g')"


@query(f"WITH {BASE}, m AS (SELECT ord, {MASK} AS source, rx, ch FROM d), u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY sha256(source) ORDER BY ord) = 1), e AS (SELECT ord, source, regexp_extract_all(source, '{RX}') AS rx, length(source) AS n FROM u) SELECT count(*) AS program_count, avg(len(rx)) AS own_mean, median(len(rx)) AS own_median, CAST(list_sort(list(len(rx)))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS DOUBLE) AS own_p95, sum(len(rx))::DOUBLE / sum(n) AS compression_ratio FROM e")
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    masked = scans.spread(docs(spark, d)).withColumn("source", T.mask_literals(F.col("source")))
    e = corpus.dedup_first(masked).withColumn("rx", tokenizers.regex_pieces(F.col("source"))).withColumn("n", F.length("source"))
    main = e.agg(F.count("*").alias("program_count"), F.avg(F.size("rx")).alias("own_mean"), F.median(F.size("rx")).alias("own_median"), metrics.compression_ratio(F.size("rx"), F.col("n")).alias("compression_ratio"))
    return main.join(F.broadcast(metrics.p95(e.select(F.size("rx").alias("v")), "v").withColumnRenamed("p95", "own_p95")), F.lit(True)).select("program_count", "own_mean", "own_median", "own_p95", "compression_ratio")


@query(f"WITH {BASE} SELECT ord, {MASK} AS masked FROM d")
def mask_literals(spark, d):
    return docs(spark, d).select("ord", T.mask_literals(F.col("source")).alias("masked"))


@query(f"WITH {BASE} SELECT ord, CAST(len(regexp_extract_all(source, '(?s)\"(?:[^\"\\\\]|\\\\.)*\\\\?(\"?)')) AS INTEGER) AS literals FROM d")
def literal_count(spark, d):
    return docs(spark, d).select("ord", T.literal_count(F.col("source")).alias("literals"))


@query("SELECT doc_id AS ord, text AS source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedup_first(spark, d):
    return corpus.dedup_first(docs(spark, d))


@query("SELECT count(*) AS total, count(DISTINCT text) AS unique_rows, count(*) - count(DISTINCT text) AS removed FROM documents")
def dedup_counts(spark, d):
    return corpus.dedup_counts(docs(spark, d))


@query("SELECT ord, CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'valid' END AS split FROM (SELECT doc_id AS ord, row_number() OVER (ORDER BY sha256('42:' || doc_id)) AS r, count(*) OVER () AS n FROM documents)")
def split_hash(spark, d):
    return corpus.split_by_hash(docs(spark, d), 0.9).select("ord", "split")


@query("SELECT CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'valid' END AS split, count(*) AS n_rows FROM (SELECT row_number() OVER (ORDER BY sha256('42:' || doc_id)) AS r, count(*) OVER () AS n FROM documents) GROUP BY 1")
def split_sizes(spark, d):
    return corpus.split_by_hash(docs(spark, d), 0.9).groupBy("split").agg(F.count("*").alias("n_rows"))


@query("SELECT doc_id AS ord FROM documents ORDER BY sha256('42:' || doc_id) LIMIT 100")
def sample_hash(spark, d):
    return corpus.sample_by_hash(docs(spark, d), 100).select("ord")


@query()
def split_exact(spark, d):
    return corpus.split_exact(docs(spark, d).select("ord"), 0.9)


@query()
def sample_exact(spark, d):
    return corpus.sample_exact(docs(spark, d).select("ord"), 100)


@query("SELECT doc_id AS ord, text AS source FROM documents ORDER BY doc_id LIMIT 200")
def head_limit(spark, d):
    return corpus.head(docs(spark, d), 200)


@query("SELECT doc_id AS ord, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS INTEGER) AS nonblank FROM documents")
def line_counts(spark, d):
    return docs(spark, d).select("ord", T.line_count(F.col("source")).alias("n_lines"), F.size(T.nonblank_lines(F.col("source"))).alias("nonblank"))


@query("SELECT ord, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line FROM (SELECT doc_id AS ord, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(ls[i], ' ' || chr(9) || chr(13)) <> ''")
def nonblank_lines(spark, d):
    rows = docs(spark, d).select("ord", F.posexplode(T.lines(F.col("source"))).alias("line_no", "line"))
    return rows.filter(~T.is_blank(F.col("line")))


def stats_sql(c: str) -> str:
    return f"WITH {BASE} SELECT avg(len({c})) AS mean, median(len({c})) AS median, CAST(list_sort(list(len({c})))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS DOUBLE) AS p95 FROM d"


@query(stats_sql("rx"))
def token_stats_regex(spark, d):
    return metrics.token_stats(encoded(spark, d), "rx")


@query(stats_sql("ch"))
def token_stats_char(spark, d):
    return metrics.token_stats(encoded(spark, d), "ch")


@query("SELECT CAST(list_sort(list(length(text)))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS DOUBLE) AS p95 FROM documents")
def p95_exact(spark, d):
    return metrics.p95(docs(spark, d).select(F.length("source").alias("v")), "v")


@query(f"WITH {BASE} SELECT sum(len(rx))::DOUBLE / sum(len(ch)) AS compression_ratio FROM d")
def compression_ratio(spark, d):
    return encoded(spark, d).agg(metrics.compression_ratio(F.size("rx"), F.size("ch")).alias("compression_ratio"))


@query(f"WITH {BASE} SELECT sum(len(rx))::DOUBLE / sum(length(source)) AS tokens_per_char FROM d")
def tokens_per_char_micro(spark, d):
    return encoded(spark, d).agg(metrics.tokens_per_char(F.col("rx"), F.col("source")).alias("tokens_per_char"))


@query(f"WITH {BASE} SELECT ord, len(rx)::DOUBLE / length(source) AS fertility, CASE WHEN len(rx) > 0 THEN length(source)::DOUBLE / len(rx) END AS chars_per_token, len(rx)::DOUBLE / len(string_split(source, chr(10))) AS tokens_per_line FROM d")
def row_ratios(spark, d):
    c = F.col("source")
    return encoded(spark, d).select("ord", T.ratio(F.size("rx"), F.length(c)).alias("fertility"), T.ratio(F.length(c), F.size("rx")).alias("chars_per_token"), T.ratio(F.size("rx"), T.line_count(c)).alias("tokens_per_line"))


ROUND9 = "CAST(round({} * 1e9) AS BIGINT)"


@query(f"WITH {BASE} SELECT {ROUND9.format('avg(len(rx)::DOUBLE / nullif(length(source), 0))')} AS fertility_e9, {ROUND9.format('avg(length(source)::DOUBLE / nullif(len(rx), 0))')} AS chars_per_token_e9, {ROUND9.format('avg(len(rx)::DOUBLE / len(string_split(source, chr(10))))')} AS tokens_per_line_e9 FROM d")
def macro_ratios(spark, d):
    c, e9 = F.col("source"), lambda x: F.round(x * 1e9).cast("bigint")
    return encoded(spark, d).agg(e9(metrics.fertility(F.col("rx"), c)).alias("fertility_e9"), e9(metrics.chars_per_token(F.col("rx"), c)).alias("chars_per_token_e9"), e9(metrics.tokens_per_line_macro(F.col("rx"), c)).alias("tokens_per_line_e9"))


@query(f"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT sum(len(regexp_extract_all(line, '{RX}')))::DOUBLE / count(*) AS tokens_per_line FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''")
def tokens_per_line_micro(spark, d):
    l = docs(spark, d).select(F.explode(T.nonblank_lines(F.col("source"))).alias("line"))
    return l.agg(F.try_divide(F.sum(F.size(tokenizers.regex_pieces(F.col("line")))).cast("double"), F.count("*")).alias("tokens_per_line"))


@query(f"WITH {BASE} SELECT count(DISTINCT p) AS used, count(DISTINCT p)::DOUBLE / 100000 AS vocab_utilization FROM (SELECT unnest(rx) AS p FROM d)")
def vocab_utilization(spark, d):
    return metrics.vocab_utilization(encoded(spark, d), "rx", 100_000)


@query(f"WITH {BASE} SELECT p AS piece, count(*) AS n FROM (SELECT unnest(rx) AS p FROM d) GROUP BY 1")
def vocab_table(spark, d):
    return encoded(spark, d).select(F.explode("rx").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def count_sql(p: str) -> str:
    return f"CAST(sum((length(text) - length(replace(text, '{p}', ''))) // {len(p)}) AS BIGINT)"


def some_sql(ps: list[str]) -> str:
    return " + ".join(count_sql(p) for p in ps) + " > 0"


@query("SELECT " + ", ".join(f"{count_sql(p)} AS n_{i}" for i, p in enumerate(patterns.COUNTED)) + f", CAST(sum(length(text)) AS BIGINT) AS chars, {some_sql(patterns.NEW_COUNTED)} AS uses_new, {some_sql(patterns.OLD_COUNTED)} AS uses_old FROM documents")
def syntax_flags(spark, d):
    return patterns.syntax_counts(docs(spark, d))


@query(f"WITH {VOCABS}, v AS (SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS id FROM b), t AS (SELECT unnest({patterns.TERMS}) AS term) SELECT term, count(*) AS hits, CAST(min(id) AS BIGINT) AS first_id FROM v JOIN t ON contains(piece, term) WHERE id >= 2 GROUP BY term")
def vocab_search(spark, d):
    v = corpus.with_positions(vocab(spark, d, "conversations"), "piece").select("piece", F.col("_n").alias("id"))
    return patterns.vocab_search(v, patterns.terms(spark), 2).select("term", "hits", "first_id")


CATALOGUE_SQL = ", ".join(f"('{c}', {i}, '{p}')" for c, ps in patterns.CATALOGUE.items() for i, p in enumerate(ps))


@query(f"SELECT category, CAST(pos AS INTEGER) AS pos, pattern, CAST(len(regexp_extract_all(pattern, '{RX}')) AS INTEGER) AS num_pieces, len(regexp_extract_all(pattern, '{RX}')) = 1 AS is_single_token FROM (VALUES {CATALOGUE_SQL}) t(category, pos, pattern)")
def pattern_single(spark, d):
    return patterns.single_tokens(patterns.catalogue(spark), tokenizers.regex_pieces(F.col("pattern"))).drop("pieces")


@query(f"WITH c AS (SELECT category, len(regexp_extract_all(pattern, '{RX}')) = 1 AS s FROM (VALUES {CATALOGUE_SQL}) t(category, pos, pattern)) SELECT count(*) FILTER (category IN {tuple(patterns.NEW)} AND s) AS new_single, count(*) FILTER (category IN {tuple(patterns.NEW)}) AS new_total, count(*) FILTER (category IN {tuple(patterns.OLD)} AND s) AS old_single, count(*) FILTER (category IN {tuple(patterns.OLD)}) AS old_total, count(*) FILTER (category IN {tuple(patterns.NEW)} AND s) < count(*) FILTER (category IN {tuple(patterns.NEW)}) * 0.5 AS needs_retraining FROM c")
def pattern_rates(spark, d):
    return patterns.rates(patterns.single_tokens(patterns.catalogue(spark), tokenizers.regex_pieces(F.col("pattern"))))


OVERLAP = f"WITH {VOCABS}, n AS (SELECT count(a.piece) AS own_size, count(b.piece) AS base_size, count(*) FILTER (a.piece IS NOT NULL AND b.piece IS NOT NULL) AS shared, count(*) AS union_size FROM a FULL JOIN b ON a.piece = b.piece)"


@query(f"{OVERLAP} SELECT own_size, base_size, shared, union_size, own_size - shared AS novel, shared::DOUBLE / union_size AS jaccard, shared::DOUBLE / own_size * 100 AS overlap_pct, (own_size - shared)::DOUBLE / own_size * 100 AS novel_pct FROM n")
def vocab_overlap(spark, d):
    return alignment.vocab_overlap(vocab(spark, d, "benchmark"), vocab(spark, d, "conversations"))


@query(f"WITH {VOCABS} SELECT piece FROM a WHERE piece NOT IN (SELECT piece FROM b) ORDER BY piece COLLATE \"binary\" LIMIT 200".replace(' COLLATE "binary"', ""))
def novel_pieces_top200(spark, d):
    return alignment.novel_pieces(vocab(spark, d, "benchmark"), vocab(spark, d, "conversations"))


@query(f"{OVERLAP} SELECT (own_size - shared)::DOUBLE / own_size * 100 AS novel_pct, CASE WHEN (own_size - shared)::DOUBLE / own_size * 100 > 30 THEN 'vocab_extension_prototype' ELSE 'use_base_tokenizer_directly' END AS action, CASE WHEN (own_size - shared)::DOUBLE / own_size * 100 > 30 THEN 'low' ELSE 'high' END AS feasibility, false AS partial FROM n")
def recommendation(spark, d):
    return alignment.recommendation(alignment.vocab_overlap(vocab(spark, d, "benchmark"), vocab(spark, d, "conversations")))


COMPARE = f"WITH {BASE}, c AS (SELECT ord AS sample_index, CAST(length(source) AS INTEGER) AS source_length_chars, CAST(len(rx) AS INTEGER) AS own_token_count, CAST(len(ch) AS INTEGER) AS base_token_count, CASE WHEN len(rx) > 0 THEN len(ch)::DOUBLE / len(rx) ELSE 0 END AS ratio, CAST(len(list_distinct(list_intersect(rx, ch))) AS INTEGER) AS shared_unique, CAST(len(list_distinct(rx)) - len(list_distinct(list_intersect(rx, ch))) AS INTEGER) AS own_only_unique, CAST(len(list_distinct(ch)) - len(list_distinct(list_intersect(rx, ch))) AS INTEGER) AS base_only_unique, substring(source, 1, 120) AS source_preview FROM d)"


@query(f"{COMPARE} SELECT * FROM c")
def per_sample_compare(spark, d):
    return alignment.compare(encoded(spark, d), "rx", "ch")


@query(f"{COMPARE} SELECT sample_index, ratio, own_token_count, base_token_count, source_preview FROM c WHERE ratio > 1.5")
def expansions(spark, d):
    return alignment.expansions(alignment.compare(encoded(spark, d), "rx", "ch"))


@query("SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS ord, source FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text || chr(10) || chr(10) || role, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS b, unnest(range(1, len(b) + 1)) AS i, b[i] AS source FROM conversations)")
def program_blocks(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").withColumn("value", F.concat("text", F.lit("\n\n"), "role"))
    return scans.programs(t, F.col("value"), "conv_id", "turn")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("props").alias("value"))
    return scans.parsed(e).select("event_id", F.try_variant_get("record", "$.k", "bigint").alias("k"))


WORD_SQL = "▁?(?:[A-Za-z_]+|[0-9]+|[^A-Za-z_0-9\\s▁]+)|▁|\\n|[^\\S\\n]"


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(replace(text, ' ', '▁'), '{WORD_SQL}')) AS word FROM documents) WHERE word <> chr(10) GROUP BY word")
def bpe_histogram(spark, d):
    return bpe.histogram(scans.spread(docs(spark, d)))


@query(f"WITH w AS (SELECT unnest(regexp_extract_all(replace(text, ' ', '▁'), '{WORD_SQL}')) AS word FROM documents), p AS (SELECT word, unnest(range(1, length(word))) AS i FROM w WHERE word <> chr(10) AND length(word) > 1) SELECT word[i] AS a, word[i + 1] AS b, count(*) AS n FROM p GROUP BY 1, 2")
def bpe_pair_counts(spark, d):
    return bpe.pair_counts(scans.spread(docs(spark, d)))


@query()
def bpe_merges(spark, d):
    model = bpe.train(scans.spread(docs(spark, d)), bpe.Config())
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(model.merges)], "rank int, a string, b string")


@query("SELECT count(*) AS passed, count(*) AS total, 100.0::DOUBLE AS coverage FROM documents")
def bpe_roundtrip(spark, d):
    model = bpe.train(scans.spread(docs(spark, d)), bpe.Config())
    e = bpe.encode(scans.spread(docs(spark, d)), model)
    return e.agg(*metrics.roundtrip(F.col("decoded") == F.col("source")), metrics.coverage_percent(F.col("ids"), 0).alias("coverage"))


from . import scan_queries  # noqa: E402, F401  registers the queries over files, reports and programs
