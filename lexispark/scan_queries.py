"""Queries that write the driver's tables as files and scan them back, and those of reports, gates and programs."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import alignment, bpe, corpus, metrics, patterns, tokenizers
from .plans import pipelines, reports
from .queries import BASE, CATALOGUE_SQL, COMPARE, RX, VOCABS, docs, encoded, query, vocab
from .sources import scans, sinks

FIELDS = ("tk_source", "toke_source", "source")


def fixture(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one that the session names; on a single machine its temporary one does."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    path = Path((base or tempfile.gettempdir()).removeprefix("file://").removeprefix("file:"), f"{name}-{uuid.uuid4().hex}")
    path.mkdir(parents=True)
    return str(path)


def json_line(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def cases(by: Column, *values: Column) -> Column:
    out = F.when(by == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(by == i, v)
    return out


def one_file(df: DataFrame, path: str, *order: str) -> str:
    """df's column value as one file, in order: for fixtures of ids and pieces, not of texts."""
    df.repartition(1).sortWithinPartitions(*order).select("value").write.text(path)
    return path


def row(spark: SparkSession, **values: object) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


@query("SELECT text AS source FROM documents WHERE doc_id % 10 >= 4 AND text <> ''")
def jsonl_strict(spark, d):
    s, path = F.col("source"), fixture(spark, "jsonl") + "/c.jsonl"
    line = F.coalesce(cases(F.col("ord") % 10, F.lit("not json"), F.lit('{"other": 1}'), F.lit('{"tk_source": ""}'), F.lit('{"tk_source": 5}')), json_line(tk_source=s))
    docs(spark, d).select(line.alias("value")).write.text(path)
    return scans.read_jsonl(spark, path, strict=True)[0].select("source")


@query("SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) AS line_no, CASE doc_id % 10 WHEN 0 THEN 'malformed' ELSE 'missing field' END AS reason, CASE doc_id % 10 WHEN 0 THEN 'not json ' || doc_id WHEN 1 THEN '{\"other\": ' || doc_id || '}' WHEN 2 THEN '{\"tk_source\": \"\"}' WHEN 3 THEN '{\"tk_source\": 5}' END AS raw FROM documents) WHERE raw IS NOT NULL")
def jsonl_rejects(spark, d):
    i = F.col("ord").cast("string")
    line = F.coalesce(
        cases(F.col("ord") % 10, F.concat(F.lit(" not json "), i), F.concat(F.lit('{"other": '), i, F.lit("}")), F.lit('{"tk_source": ""}'), F.lit('{"tk_source": 5}'), F.lit("")), json_line(tk_source=i)
    )
    path = one_file(docs(spark, d).select("ord", line.alias("value")), fixture(spark, "rejects") + "/c.jsonl", "ord")
    return scans.read_jsonl(spark, path, strict=True)[1]


@query("SELECT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS source FROM documents WHERE doc_id % 6 IN (0, 1, 2, 5)")
def jsonl_fallback(spark, d):
    s, empty, none = F.col("source"), F.lit(""), F.lit(None).cast("string")
    line = cases(
        F.col("ord") % 6, json_line(tk_source=s), json_line(tk_source=empty, toke_source=F.concat(F.lit("  "), s, F.lit(" \t"))), json_line(tk_source=none, source=s), json_line(tk_source=F.lit(7), toke_source=s),
        json_line(tk_source=F.lit("   "), toke_source=s), json_line(tk_source=F.array().cast("array<string>"), toke_source=F.lit(False), source=s),
    )
    path = fixture(spark, "fallback") + "/c.jsonl"
    docs(spark, d).select(line.alias("value")).write.text(path)
    return scans.read_fallback_jsonl(spark, path, FIELDS).select("source")


TREE = {"a/b.json": '{"tk_source": "1"}', "a-b/c.json": '{"source": " 2 "}', "a.json": '{"tk_source": "", "toke_source": "3"}', "manifest.json": '{"tk_source": "no"}', "x/schema.json": '{"tk_source": "no"}', "z/bad.json": "not json",
        "z/q.jsonl": '{"tk_source": "5"}\n\nbad\n{"tk_source": "6"}\n', "b/p.jsonl": '{"tk_source": "4"}\n'}


def tree(spark: SparkSession) -> str:
    base = fixture(spark, "tree")
    for name, text in TREE.items():
        p = Path(base, name)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return base


@query("SELECT * FROM (VALUES (0, '1'), (1, '2'), (2, '3'), (3, '4'), (4, '5'), (5, '6')) t(n, source)")
def directory_scan(spark, d):
    rows = scans.read_directory(spark, tree(spark), FIELDS)
    return corpus.with_positions(rows).select(F.col("_n").cast("int").alias("n"), "source")


@query("SELECT * FROM (VALUES (0, '4'), (1, '5'), (2, '6'), (3, '1')) t(n, source)")
def directory_head(spark, d):
    rows = scans.read_directory(spark, tree(spark), FIELDS, json_first=False, limit=4)
    return corpus.with_positions(rows).select(F.col("_n").cast("int").alias("n"), "source")


BLOCKS = "SELECT unnest(list_filter(list_transform(string_split(replace(replace(rtrim(text, chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS source FROM documents"


@query(BLOCKS)
def program_file(spark, d):
    path = fixture(spark, "programs") + "/p.txt"
    sinks.write_program_text(docs(spark, d), path)
    return scans.read_programs(spark, path).select("source")


@query(BLOCKS)
def program_parts(spark, d):
    path = fixture(spark, "parts") + "/p.txt"
    sinks.write_program_parts(docs(spark, d), path)
    return scans.read_programs(spark, path).select("source")


LITERAL_COUNTS = ", ".join(f"CAST(sum((length(text) - length(replace(text, '{p}', ''))) // {len(p)}) AS BIGINT) AS n_{i}" for i, p in enumerate(patterns.COUNTED))


@query(f"WITH t AS (SELECT rtrim(text, chr(10)) AS text FROM documents) SELECT {LITERAL_COUNTS}, CAST(sum(length(text)) + 2 * (count(*) - 1) + 1 AS BIGINT) AS chars FROM t")
def whole_text(spark, d):
    path = fixture(spark, "whole") + "/p.txt"
    sinks.write_program_text(docs(spark, d), path)
    return patterns.file_syntax_counts(spark, path).drop("uses_new", "uses_old")


@query("SELECT CAST(sum(length(text)) + 2 * (count(*) - 1) + 1 AS BIGINT) AS chars FROM documents")
def corpus_chars(spark, d):
    return docs(spark, d).agg(metrics.corpus_chars(F.col("source")).alias("chars"))


@query(f"WITH {VOCABS} SELECT CAST(row_number() OVER (ORDER BY piece) - 1 AS INTEGER) AS id, piece, CAST(-length(piece) AS FLOAT) AS score FROM a")
def vocab_tsv(spark, d):
    lines = vocab(spark, d, "benchmark").select("piece", F.concat("piece", F.lit("\t-"), F.length("piece").cast("string")).alias("value"))
    return scans.read_vocab_tsv(spark, one_file(lines, fixture(spark, "tsv") + "/m.vocab", "piece"))


@query(f"WITH {VOCABS} SELECT piece, CAST(length(piece) AS INTEGER) AS id FROM b")
def vocab_json(spark, d):
    path = fixture(spark, "json") + "/vocab.json"
    entries = vocab(spark, d, "conversations").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("piece", F.length("piece"))))).alias("value"))
    entries.write.text(path)
    return scans.read_vocab_json(spark, path)


@query("SELECT 600 AS n_pieces, true AS same")
def model_files(spark, d):
    model, path = bpe.train(spark.read.parquet(f"{d}/benchmark.parquet"), bpe.Config(vocab_size=600), "text"), fixture(spark, "model")
    bpe.save(spark, model, path)
    back = bpe.load(spark, path)
    return row(spark, n_pieces=len(back.pieces()), same=back.pieces() == model.pieces() and back == model).select(F.col("n_pieces").cast("int"), "same")


MASK = "regexp_replace(text, '(?s)\"(?:[^\"\\\\]|\\\\.)*\\\\?(\"?)', '\"<STR>\\1', 'g')"


@query(f"SELECT count(*) AS total, CAST(0 AS BIGINT) AS rejected, CAST(floor(count(DISTINCT {MASK}) * 0.9) AS BIGINT) AS train, CAST(count(DISTINCT {MASK}) - floor(count(DISTINCT {MASK}) * 0.9) AS BIGINT) AS valid, count(DISTINCT {MASK}) AS unique_rows FROM documents")
def prepared(spark, d):
    base = fixture(spark, "prepare")
    docs(spark, d).select(json_line(tk_source=F.col("source")).alias("value")).write.text(f"{base}/c.jsonl")
    n = pipelines.prepare(spark, f"{base}/c.jsonl", f"{base}/out", exact=False)
    return row(spark, total=n["total"], rejected=n["rejected"], train=n["train"], valid=n["valid"], unique_rows=n["unique"])


@query("WITH t AS (SELECT DISTINCT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM benchmark) SELECT count(*) AS unique_rows, CAST(sum(strlen(s)) + 2 * (count(*) - 1) + 1 AS BIGINT) AS training_bytes, CAST(14 AS BIGINT) AS symbols, '100/100' AS roundtrip, CAST(100 AS DOUBLE) AS coverage FROM t")
def retrained(spark, d):
    base = fixture(spark, "retrain")
    spark.read.parquet(f"{d}/benchmark.parquet").select(json_line(source=F.col("text")).alias("value")).write.text(f"{base}/c.jsonl")
    r = pipelines.retrain(spark, f"{base}/c.jsonl", base, FIELDS, 600)
    passed, total = r["new"]["passed"], r["new"]["total"]
    assert json.loads(Path(base, "retrain.json").read_text())["unique"] == r["unique"]
    return row(spark, unique_rows=r["unique"], training_bytes=r["training_bytes"], symbols=len(r["user_defined_symbols"]), roundtrip=f"{100 * passed // total}/100", coverage=float(r["new"]["coverage"]))


def stats_sql(c: str, name: str) -> str:
    return f"avg(len({c})) AS {name}_mean, median(len({c})) AS {name}_median, CAST(list_sort(list(len({c})))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS DOUBLE) AS {name}_p95"


REPORT = f"WITH {BASE}, r AS (SELECT count(*) AS program_count, {stats_sql('rx', 'own')}, {stats_sql('ch', 'baseline')}, sum(len(rx))::DOUBLE / sum(len(ch)) AS compression_ratio, CAST(round(avg(len(rx)::DOUBLE / nullif(length(source), 0)) * 1e9) AS BIGINT) AS fertility_e9 FROM d), u AS (SELECT count(DISTINCT p)::DOUBLE / 100000 AS vocab_utilization FROM (SELECT unnest(rx) AS p FROM d))"


@query(f"{REPORT} SELECT r.*, vocab_utilization, 100000 AS vocab_size FROM r, u")
def evaluation_report(spark, d):
    r = reports.evaluation(encoded(spark, d), "rx", "ch", 100_000)
    stats = [F.col(f"{who}.{k}").alias(f"{who}_{k}") for who in ("own", "baseline") for k in ("mean", "median", "p95")]
    return r.select("program_count", *stats, "compression_ratio", F.round(F.col("fertility") * 1e9).cast("bigint").alias("fertility_e9"), "vocab_utilization", "vocab_size")


@query(f"{REPORT} SELECT program_count, own_mean, own_p95, baseline_median, vocab_utilization FROM r, u")
def report_file(spark, d):
    path = fixture(spark, "report") + "/r.json"
    sinks.write_report(reports.as_dict(reports.evaluation(encoded(spark, d), "rx", "ch", 100_000)), path)
    back = spark.read.json(path, multiLine=True)
    return back.select("program_count", F.col("own.mean").alias("own_mean"), F.col("own.p95").alias("own_p95"), F.col("baseline.median").alias("baseline_median"), "vocab_utilization")


@query(f"{REPORT} SELECT unnest([printf('Programs evaluated:   %8d', program_count), printf('Own tokens/program: mean %.1f, median %.1f, p95 %.1f', own_mean, own_median, own_p95), printf('Compression ratio:    %.4f', compression_ratio), printf('Vocab utilization:    %.4f', vocab_utilization)]) AS line FROM r, u")
def report_summary(spark, d):
    text = reports.summary(reports.as_dict(reports.evaluation(encoded(spark, d), "rx", "ch", 100_000)))
    some = [x for x in text.splitlines() if x.startswith(("Programs", "Own", "Compression", "Vocab util"))]
    return spark.createDataFrame([(x,) for x in some], "line string")


@query("SELECT uses_new, needs, CASE WHEN uses_new IS NOT DISTINCT FROM false THEN 'trained on old syntax: retrain' WHEN needs THEN 'under half of the new patterns are single tokens: retrain' ELSE 'new patterns are well represented' END AS reason FROM (VALUES (true), (false), (NULL)) a(uses_new), (VALUES (true), (false)) b(needs)")
def syntax_verdict(spark, d):
    all_ = spark.createDataFrame([(u, n) for u in (True, False, None) for n in (True, False)], "uses_new boolean, needs boolean")
    return all_.withColumn("reason", patterns.reason(F.col("uses_new"), F.col("needs")))


@query(f"WITH {BASE}, r AS (SELECT sum(len(rx))::DOUBLE / sum(length(source)) AS own, sum(len(ch))::DOUBLE / sum(length(source)) AS base FROM d) SELECT CASE WHEN own <= 1.8 THEN 'PASS' ELSE 'FAIL' END AS own_gate, CASE WHEN base * 2 <= 1.8 THEN 'PASS' ELSE 'FAIL' END AS twice_gate FROM r")
def ctr_gate(spark, d):
    own, base = metrics.tokens_per_char(F.col("rx"), F.col("source")), metrics.tokens_per_char(F.col("ch"), F.col("source"))
    return encoded(spark, d).agg(own.alias("own"), base.alias("base")).select(reports.gate(F.col("own")).alias("own_gate"), reports.gate(F.col("base") * 2).alias("twice_gate"))


@query(f"WITH {BASE}, r AS (SELECT sum(len(rx))::DOUBLE / sum(length(source)) AS own, sum(len(ch))::DOUBLE / sum(length(source)) AS base, sum(len(rx)) AS n_own, sum(len(ch)) AS n_base FROM d) SELECT base - own AS improvement, CAST(n_base - n_own AS BIGINT) AS fewer_tokens FROM r")
def metric_deltas(spark, d):
    rx, ch, s = F.col("rx"), F.col("ch"), F.col("source")
    r = encoded(spark, d).agg(metrics.tokens_per_char(rx, s).alias("own"), metrics.tokens_per_char(ch, s).alias("base"), F.sum(F.size(rx)).alias("n_own"), F.sum(F.size(ch)).alias("n_base"))
    return r.select((F.col("base") - F.col("own")).alias("improvement"), (F.col("n_base") - F.col("n_own")).alias("fewer_tokens"))


SINGLE = f"c AS (SELECT category, pos, pattern, len(regexp_extract_all(pattern, '{RX}')) AS rx, length(pattern) AS ch FROM (VALUES {CATALOGUE_SQL}) t(category, pos, pattern))"
REQUIRED_SQL = ", ".join(f"({i}, '{p}')" for i, p in enumerate(patterns.REQUIRED))


def checked(spark: SparkSession, kind: str, table: DataFrame | None = None) -> DataFrame:
    return patterns.single_tokens(patterns.catalogue(spark) if table is None else table, tokenizers.PIECES[kind](F.col("pattern")))


@query(f"WITH {SINGLE} SELECT pattern, ch = 1 AS old_single, rx = 1 AS new_single, (ch = 1) <> (rx = 1) AS changed FROM c")
def pattern_changes(spark, d):
    return patterns.changed(checked(spark, "char"), checked(spark, "regex"))


@query(f"WITH {SINGLE} SELECT r.pattern, CAST(coalesce(rx, 0) AS INTEGER) AS num_pieces, coalesce(rx = 1, false) AS is_single_token FROM (VALUES {REQUIRED_SQL}) r(pos, pattern) LEFT JOIN (SELECT DISTINCT pattern, rx FROM c) USING (pattern)")
def pattern_lookup(spark, d):
    found = patterns.looked_up(patterns.required(spark), checked(spark, "regex"))
    return found.select("pattern", F.coalesce("num_pieces", F.lit(0)).alias("num_pieces"), "is_single_token")


@query(f"SELECT pattern FROM (VALUES {REQUIRED_SQL}) r(pos, pattern) WHERE len(regexp_extract_all(pattern, '{RX}')) <> 1")
def missing_patterns(spark, d):
    return patterns.missing(checked(spark, "regex", patterns.required(spark)))


@query(f"WITH {SINGLE}, n AS (SELECT category IN {tuple(patterns.NEW)} AS new, count(*) FILTER (rx = 1) AS s, count(*) AS t FROM c WHERE category IN {tuple(patterns.NEW + patterns.OLD)} GROUP BY 1) SELECT max(s || '/' || t) FILTER (new) AS new_rate, max(s || '/' || t) FILTER (NOT new) AS old_rate FROM n")
def fraction_rates(spark, d):
    return patterns.rates(checked(spark, "regex")).select(F.concat_ws("/", "new_single", "new_total").alias("new_rate"), F.concat_ws("/", "old_single", "old_total").alias("old_rate"))


@query(f"WITH {VOCABS}, t AS (SELECT unnest({patterns.TERMS}) AS term), h AS (SELECT term, count(*) AS hits FROM b JOIN t ON contains(piece, term) GROUP BY term) SELECT string_agg(term || ': ' || hits, chr(10) ORDER BY term) AS report FROM h")
def vocab_terms_sorted(spark, d):
    v = vocab(spark, d, "conversations").withColumn("id", F.lit(0))
    hits = patterns.vocab_search(v, patterns.terms(spark)).select("term", "hits").orderBy("term").collect()  # at most a row for each term
    return row(spark, report="\n".join(f"{h['term']}: {h['hits']}" for h in hits))


@query(f"WITH {VOCABS}, n AS (SELECT piece, row_number() OVER (ORDER BY piece) AS r, count(*) OVER () AS n FROM (SELECT piece FROM a WHERE piece NOT IN (SELECT piece FROM b))) SELECT '- `' || piece || '`' AS line FROM n WHERE r <= 50 UNION ALL SELECT '... and ' || (least(n, 200) - 50) || ' more' FROM n WHERE r = 51")
def display_limits(spark, d):
    a, b = vocab(spark, d, "benchmark"), vocab(spark, d, "conversations")
    novel = [r["piece"] for r in alignment.novel_pieces(a, b).collect()]  # at most 200
    overlap = alignment.vocab_overlap(a, b)
    text = reports.alignment_markdown(overlap.first().asDict(), novel, [], [], alignment.recommendation(overlap).first().asDict(), False)
    lines = text.split("## Novel pieces\n\n")[1].split("\n\n## ")[0].splitlines()
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("SELECT CAST(100 AS DOUBLE) AS novel_pct, 'vocab_extension_prototype' AS action, 'low' AS feasibility, true AS partial")
def partial_recommendation(spark, d):
    own = vocab(spark, d, "benchmark")
    return alignment.recommendation(alignment.vocab_overlap(own, own.limit(0)), True)


@query(f"{COMPARE} SELECT CAST(round(avg(ratio) FILTER (ratio > 0) * 1e9) AS BIGINT) AS avg_ratio_e9 FROM c")
def average_ratio(spark, d):
    return alignment.average_ratio(alignment.compare(encoded(spark, d), "rx", "ch")).select(F.round(F.col("avg_ratio") * 1e9).cast("bigint").alias("avg_ratio_e9"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("SELECT doc_id AS ord, CAST(strlen(text) AS BIGINT) AS n_bytes, true AS same FROM documents")
def rank_file_tokens(spark, d):
    """Every text by a file of byte-pair ranks: its tokens' bytes are the text's."""
    _, encode = tokenizers.open_tokenizer(tokenizer_file("byte_bpe_50k.tiktoken"))
    e = scans.spread(docs(spark, d)).withColumn("_e", encode(F.col("source")))
    return e.select("ord", F.aggregate("_e.pieces", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p)).alias("n_bytes"), (F.col("_e.decoded") == F.col("source")).alias("same"))


@query()
def sentencepiece_tokens(spark, d):
    """Tokens of every text by an installed SentencePiece model; tests compare them with the library's own."""
    encode = tokenizers.sentencepiece_encoder(tokenizer_file("piece_bpe_32k.model"), ids_only=True)
    return scans.spread(docs(spark, d)).withColumn("_e", encode(F.col("source"))).select("ord", F.size("_e.ids").alias("n_tokens"), F.sha2(F.array_join(F.col("_e.ids").cast("array<string>"), " "), 256).alias("ids_sha256"))


@query("SELECT * FROM (VALUES ('prepare', 1), ('train', 1), ('train_folder', 1), ('train_size', 1), ('eval', 1), ('eval_baseline', 1), ('retrain', 1), ('dry_run', 0)) t(program, code)")
def validation_codes(spark, d):
    base = fixture(spark, "codes")
    none, text = f"{base}/none", Path(base, "t.txt")
    text.write_text("a b\n\nc d\n")
    bpe.save(spark, bpe.Model([], ["a"], ()), f"{base}/model")
    calls = {
        "prepare": ["prepare", "--input", none, "--output-dir", base], "train": ["train", "--input", none, "--output-dir", base], "train_folder": ["train", "--input", base, "--output-dir", base],
        "train_size": ["train", "--input", text, "--output-dir", base, "--vocab-size", -1], "eval": ["eval", "--model", none, "--test-data", text], "eval_baseline": ["eval", "--model", f"{base}/model", "--test-data", text, "--baseline", none],
        "retrain": ["retrain", "--corpus-jsonl", none, "--output-dir", base], "dry_run": ["eval", "--model", f"{base}/model", "--test-data", text, "--dry-run"],
    }
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        codes = [(name, pipelines.main([*map(str, args)], spark)) for name, args in calls.items()]
    return spark.createDataFrame(codes, "program string, code int")


@query("SELECT * FROM (VALUES ('refused', false, 'old', NULL), ('allowed', true, 'new', 'old'), ('fresh', true, 'new', NULL)) t(step, installed, current, backup)")
def promotion(spark, d):
    base = Path(fixture(spark, "promotion"))
    for name in ("old", "new"):
        (base / name).mkdir()
        (base / name / "model").write_text(name)
    os.rename(base / "old", base / "registry")
    read = lambda p: p.read_text() if p.exists() else None
    out = []
    for step, target, allowed in (("refused", "registry", False), ("allowed", "registry", True), ("fresh", "other", True)):
        done = sinks.promote(str(base / "new"), str(base / target), allowed)
        out.append((step, done, read(base / target / "model"), read(base / f"{target}.old" / "model")))
    return spark.createDataFrame(out, "step string, installed boolean, current string, backup string")


@query("SELECT * FROM (VALUES ('no_such_module', false), ('json', true), ('file_missing', false), ('ending_unknown', false)) t(what, usable)")
def optional_dependencies(spark, d):
    found = [(m, tokenizers.available(m)) for m in ("no_such_module", "json")]
    found += [("file_missing", tokenizers.open_tokenizer("/none.model") is not None), ("ending_unknown", tokenizers.open_tokenizer("/none.bin") is not None)]
    return spark.createDataFrame(found, "what string, usable boolean")


@query("SELECT * FROM (VALUES ('model_type', 'bpe'), ('vocab_size', '8000'), ('character_coverage', '1.0'), ('user_defined_symbols', '<STR>'), ('pad_id', '-1'), ('unk_id', '0'), ('bos_id', '1'), ('eos_id', '2'), ('normalization_rule_name', 'identity'), ('add_dummy_prefix', 'False'), ('remove_extra_whitespaces', 'False'), ('byte_fallback', 'True')) t(name, value)")
def config_defaults(spark, d):
    values = [(k, ",".join(v) if isinstance(v, list) else str(v)) for k, v in bpe.Config().as_dict().items() if k not in ("input", "model_prefix")]
    return spark.createDataFrame(values, "name string, value string")


@query("SELECT n_symbols, 3 + n_symbols AS special, size - 3 - n_symbols AS reported FROM (VALUES (1, 8000), (14, 8000), (1, 32768)) t(n_symbols, size)")
def special_counts(spark, d):
    out = []
    for symbols, size in ((("<STR>",), 8000), (tuple(patterns.REQUIRED), 8000), (("<STR>",), 32768)):
        special = bpe.special_tokens(symbols)
        out.append((len(symbols), special, size - special))
    return spark.createDataFrame(out, "n_symbols int, special int, reported int")


@query("SELECT CAST(doc_id AS BIGINT) AS ord, strlen(text) AS n FROM documents")
def byte_tokens(spark, d):
    return docs(spark, d).select(F.col("ord").cast("bigint"), F.size(tokenizers.byte_pieces(F.col("source"))).cast("bigint").alias("n"))


@query("SELECT md5(text) AS h FROM (SELECT DISTINCT text FROM documents)")
def streamed(spark, d):
    """The corpus as a stream of JSON lines: distinct sources, each written once."""
    from .streaming.ingest import ingest

    base = fixture(spark, "stream")
    docs(spark, d).select(json_line(tk_source=F.replace("source", F.lit('"'), F.lit("'"))).alias("value"), F.md5("source")).select("value").write.text(f"{base}/in")
    ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    back = spark.read.parquet(f"{base}/out").select(F.col("hash").alias("k"))
    return docs(spark, d).select(T.content_hash(T.strip(F.replace("source", F.lit('"'), F.lit("'")))).alias("k"), F.md5("source").alias("h")).distinct().join(back, "k").select("h")
