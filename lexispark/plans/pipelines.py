"""The programs: prepare, train, evaluate, retrain, syntax, align. Each has a function and a command; errors give return code 1."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mask_literals, nonblank_lines
from ..operators import alignment, bpe, corpus, metrics, patterns, tokenizers
from ..sources import scans, sinks
from . import reports


class UsageError(Exception):
    """Missing input, wrong kind of path, empty corpus, impossible size."""


def must_exist(path: str, what: str, file: bool = False) -> None:
    if not Path(path).exists():
        raise UsageError(f"{what} not found: {path}")
    if file and not Path(path).is_file():
        raise UsageError(f"{what} is not a file: {path}")


def prepare(spark: SparkSession, input_: str, output_dir: str, split: float = 0.9, seed: int = 42, exact: bool = True, fields: tuple[str, ...] = scans.FIELDS) -> dict:
    """JSON lines to masked, distinct, split text files. Masking comes before the comparison of texts."""
    must_exist(input_, "input file")
    good, rejects = scans.read_jsonl(spark, input_, fields, strict=True)
    masked = good.withColumn("source", mask_literals(F.col("source"))).persist()
    unique = corpus.dedup_first(masked)
    parts = corpus.split_exact(unique, split, seed) if exact else corpus.split_by_hash(unique, split, seed).withColumn("pos", F.col("ord"))
    parts = parts.select(F.col("pos").alias("ord"), "source", "split").persist()
    out = {"total": masked.count(), "rejected": rejects.count()}
    # the exact split makes one file of each part; the hashed one, which is for any size, folders of files
    write = sinks.write_program_text if exact else sinks.write_program_parts
    for name in ("train", "valid"):
        out[name] = write(parts.filter(F.col("split") == name), f"{output_dir}/{name}.txt")
    for df in (masked, parts):
        df.unpersist()
    return out | {"unique": out["train"] + out["valid"]}


def train(spark: SparkSession, input_: str, output_dir: str, vocab_size: int = 8000, model_type: str = "bpe", dry_run: bool = False, symbols: tuple[str, ...] = ("<STR>",)) -> dict:
    must_exist(input_, "input", file=True)
    if vocab_size < 1:
        raise UsageError("vocabulary size must be positive")
    config = bpe.Config(input=input_, model_prefix=f"{output_dir}/model", model_type=model_type, vocab_size=vocab_size, user_defined_symbols=symbols)
    if dry_run:
        return config.as_dict()
    text = spark.read.text(input_).withColumnRenamed("value", "source")
    try:
        model = bpe.train(text, config)
    except ValueError as e:
        raise UsageError(str(e)) from e
    bpe.save(spark, model, config.model_prefix)
    special = bpe.special_tokens(symbols)
    return config.as_dict() | {"special_tokens": special, "reported_merges": vocab_size - special, "merges": len(model.merges)}


def evaluate(spark: SparkSession, model_dir: str, test_data: str, output: str | None = None, baseline: str = "regex", dry_run: bool = False) -> dict:
    """model_dir: a saved model or a tokenizer file; baseline: a built-in encoder's name or a tokenizer file."""
    must_exist(model_dir, "model")
    must_exist(test_data, "test data")
    programs = scans.read_programs(spark, test_data)
    if programs.isEmpty():
        raise UsageError("no programs")
    if dry_run:
        return {"program_count": programs.count()}
    if Path(model_dir).is_file():
        vocab, encode = foreign(model_dir, "model")
        size, both = len(vocab), programs.withColumn("_e", encode(F.col("source"))).select("ord", "source", "_e.pieces")
    else:
        model = bpe.load(spark, model_dir)
        size, both = len(model.pieces()), bpe.encode(programs, model, decode=False)
    base = tokenizers.PIECES.get(baseline) or (lambda c: foreign(baseline, "baseline")[1](c)["pieces"])
    both = both.withColumn("base", base(F.col("source"))).persist()
    report = reports.as_dict(reports.evaluation(both, "pieces", "base", size))
    both.unpersist()
    if output:
        sinks.write_report(report, output)
    return report


def foreign(path: str, what: str) -> tuple[list[str], tokenizers.Encode]:
    found = tokenizers.open_tokenizer(path)
    if not found:
        raise UsageError(f"{what} cannot be opened: {path} (no such encoder or file, or its library is missing)")
    return found


def encoded_metrics(encoded: DataFrame) -> DataFrame:
    """Tokens per character, coverage and tokens in all, from one encoding."""
    return encoded.agg(metrics.tokens_per_char(F.col("pieces"), F.col("source")).alias("tokens_per_char"), metrics.coverage_percent(F.col("ids"), 0).alias("coverage"), F.sum(F.size("ids")).alias("tokens"))


def model_report(spark: SparkSession, model: bpe.Model, sources: DataFrame, n_samples: int = 200) -> dict:
    encoded = bpe.encode(sources, model).persist()
    row = encoded_metrics(encoded).first()
    sample = corpus.sample_exact(encoded, n_samples)
    ok = sample.agg(*metrics.roundtrip(F.col("decoded") == F.col("source"))).first()
    lines = bpe.encode(sources.select(F.explode(nonblank_lines(F.col("source"))).alias("source")), model)
    per_line = lines.agg(F.coalesce(F.try_divide(F.sum(F.size("ids")), F.count("*")), F.lit(0.0)).alias("x")).first()["x"]
    encoder = bpe.Encoder(model)
    single = {p: len(encoder.encode(p)) == 1 for p in patterns.REQUIRED}
    return {"tokens_per_char": row["tokens_per_char"], "coverage": row["coverage"], "roundtrip": f"{ok['passed']}/{ok['total']}", "passed": ok["passed"], "total": ok["total"], "tokens_per_line": per_line, "single_tokens": single}


def rounded(report: dict) -> dict:
    """A model's report as it is written: Python's rounding of the exact binary value."""
    digits = {"tokens_per_char": 4, "tokens_per_line": 2, "coverage": 2}
    return {k: round(v, digits[k]) if k in digits else v for k, v in report.items()}


def retrain(spark: SparkSession, corpus_jsonl: str, output_dir: str, fields: tuple[str, ...], vocab_size: int = 8000, old_model: str | None = None, install_to: str | None = None) -> dict:
    """Distinct unmasked sources, their training text, a model with the required symbols forced, five metrics, comparison with an old model, promotion if all patterns are single."""
    must_exist(corpus_jsonl, "corpus")
    sources = corpus.dedup_first(scans.read_fallback_jsonl(spark, corpus_jsonl, fields)).persist()
    text = f"{output_dir}/data/train.txt"
    n = sinks.write_program_text(sources, text)
    if not n:
        raise UsageError("no sources")
    config = bpe.Config(input=text, vocab_size=vocab_size, user_defined_symbols=tuple(patterns.REQUIRED))
    model = bpe.train(sources, config)
    bpe.save(spark, model, f"{output_dir}/model")
    new = model_report(spark, model, sources)
    encoder = bpe.Encoder(model)
    out = {
        "unique": n, "vocab_size": vocab_size, "training_bytes": Path(text).stat().st_size, "user_defined_symbols": list(config.user_defined_symbols), "new": rounded(new),
        "patterns": {p: {"is_single_token": ok, "pieces": encoder.encode(p)} for p, ok in new["single_tokens"].items()},
    }
    if old_model and Path(old_model).exists():
        old = model_report(spark, bpe.load(spark, old_model), sources)
        out["old_model_comparison"] = {
            "old": rounded(old), "tokens_per_char_improvement": round(old["tokens_per_char"] - new["tokens_per_char"], 4), "tokens_per_line_improvement": round(old["tokens_per_line"] - new["tokens_per_line"], 2),
            "coverage_change": round(new["coverage"] - old["coverage"], 2), "changed": [p for p in patterns.REQUIRED if old["single_tokens"][p] != new["single_tokens"][p]],
        }
    sources.unpersist()
    if install_to:
        out["installed"] = sinks.promote(f"{output_dir}/model", install_to, all(new["single_tokens"].values()))
    sinks.write_report(out, f"{output_dir}/retrain.json")
    return out


def syntax(spark: SparkSession, model_dir: str, train_text: str, corpus_dir: str, fields: tuple[str, ...], output: str | None = None) -> dict:
    must_exist(model_dir, "model")
    model = bpe.load(spark, model_dir)
    encoder = bpe.Encoder(model)
    found = {c: [{"pattern": p, "pieces": (x := encoder.encode(p)), "num_pieces": len(x), "is_single_token": len(x) == 1} for p in ps] for c, ps in patterns.CATALOGUE.items()}
    single = lambda cats: (sum(r["is_single_token"] for c in cats for r in found[c]), sum(len(found[c]) for c in cats))
    (new, new_total), (old, old_total) = single(patterns.NEW), single(patterns.OLD)
    vocab = spark.createDataFrame(list(enumerate(model.pieces())), "id int, piece string")
    hits = {r["term"]: r["hits"] for r in patterns.vocab_search(vocab, patterns.terms(spark), model.first_learned()).orderBy("first_id", "term").collect()}
    training = None
    if Path(train_text).exists():
        training = patterns.file_syntax_counts(spark, train_text).first().asDict()
    stats = None
    if Path(corpus_dir).is_dir():
        e = bpe.encode(scans.read_directory(spark, corpus_dir, fields, json_first=False, limit=200), model)
        main = e.agg(metrics.chars_per_token(F.col("pieces"), F.col("source")).alias("chars_per_token"), metrics.tokens_per_line_macro(F.col("pieces"), F.col("source")).alias("tokens_per_line"), F.count("*").alias("samples")).first().asDict()
        stats = {k: round(v, 3) if isinstance(v, float) else v for k, v in (main | metrics.token_stats(e, "pieces").first().asDict()).items()}
    uses = F.lit(training["uses_new"] if training else None).cast("boolean")
    needs = new < new_total * 0.5
    why = spark.range(1).select(patterns.reason(uses, F.lit(needs)).alias("r")).first()["r"]
    report = {"patterns": found, "vocab_hits": hits, "training": training, "corpus": stats, "verdict": {"new_rate": f"{new}/{new_total}", "old_rate": f"{old}/{old_total}", "needs_retraining": needs, "reason": why}}
    if output:
        sinks.write_report(report, output)
    return report


def align(spark: SparkSession, model_dir: str, base_vocab: str | None, corpus_dir: str | None, fields: tuple[str, ...], base_pieces: Column | None = None, samples: int = 100, output_dir: str | None = None, base_tokenizer: str | None = None) -> dict:
    """Vocabulary overlap and, where a foreign encoder is at hand, per-sample comparison; partial without a foreign vocabulary.

    base_tokenizer, a tokenizer file, gives vocabulary and encoder; where it cannot be opened, the result is partial.
    Ratios are rounded before they are averaged.
    """
    must_exist(model_dir, "model")
    model = bpe.load(spark, model_dir)
    own = spark.createDataFrame([(p,) for p in model.pieces()], "piece string")
    found = tokenizers.open_tokenizer(base_tokenizer) if base_tokenizer else None
    partial = not found and not (base_vocab and Path(base_vocab).exists())
    base = spark.createDataFrame([(p,) for p in found[0]], "piece string") if found else own.limit(0) if partial else scans.read_vocab_json(spark, base_vocab)
    overlap = alignment.vocab_overlap(own, base).persist()
    rec = alignment.recommendation(overlap, partial).first().asDict()
    compared: list[dict] = []
    expanded: list[dict] = []
    if not partial and corpus_dir and Path(corpus_dir).is_dir():
        sources = corpus.sample_exact(corpus.dedup_first(scans.read_directory(spark, corpus_dir, fields)), samples).select(F.col("pos").alias("ord"), "source")
        if base_pieces is None:
            base_pieces = found[1](F.col("source"))["pieces"] if found else tokenizers.regex_pieces(F.col("source"))
        both = bpe.encode(sources, model, decode=False).withColumn("base", base_pieces)
        c = alignment.compare(both, "pieces", "base").persist()
        compared = [r.asDict() | {"ratio": round(r["ratio"], 3)} for r in c.orderBy("sample_index").collect()]
        expanded = [r.asDict() | {"ratio": round(r["ratio"], 3)} for r in alignment.expansions(c).collect()]
        c.unpersist()
        average = reports.mean_rounded([x["ratio"] for x in compared])
        rec |= {"average_ratio": round(average, 3)} if average is not None else {}
    novel = [r["piece"] for r in alignment.novel_pieces(own, base).collect()]
    digits = {"jaccard": 6, "overlap_pct": 2, "novel_pct": 2}
    total = {k: round(v, digits[k]) if k in digits else v for k, v in overlap.first().asDict().items()}
    overlap.unpersist()
    report = {"overlap": total | {"novel_pieces": novel}, "recommendation": rec | {"novel_pct": total["novel_pct"]}, "partial": partial} | ({"samples": compared, "expansions": expanded} if compared else {})
    if output_dir:
        sinks.write_report(report, f"{output_dir}/alignment.json")
        Path(output_dir, "alignment.md").write_text(reports.alignment_markdown(total, novel, compared, expanded, rec, partial), encoding="utf-8")
    return report


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexispark")
    sub = p.add_subparsers(dest="program", required=True)
    fields = {"nargs": "+", "default": list(scans.FIELDS)}
    x = sub.add_parser("prepare")
    x.add_argument("--input", required=True), x.add_argument("--output-dir", required=True), x.add_argument("--split", type=float, default=0.9), x.add_argument("--seed", type=int, default=42), x.add_argument("--hash-split", action="store_true", help="split by hash and write folders, for corpora of any size")
    x = sub.add_parser("train")
    x.add_argument("--input", required=True), x.add_argument("--output-dir", required=True), x.add_argument("--vocab-size", type=int, default=8000), x.add_argument("--model-type", choices=bpe.MODEL_TYPES, default="bpe"), x.add_argument("--dry-run", action="store_true")
    x = sub.add_parser("eval")
    x.add_argument("--model", required=True), x.add_argument("--test-data", required=True), x.add_argument("--output"), x.add_argument("--baseline", default="regex", help=f"{', '.join(tokenizers.PIECES)} or a tokenizer file"), x.add_argument("--dry-run", action="store_true")
    x = sub.add_parser("retrain")
    x.add_argument("--corpus-jsonl", required=True), x.add_argument("--output-dir", required=True), x.add_argument("--old-model"), x.add_argument("--install-to"), x.add_argument("--vocab-size", type=int, default=8000), x.add_argument("--fields", **fields)
    x = sub.add_parser("syntax")
    x.add_argument("--model", required=True), x.add_argument("--train-text", required=True), x.add_argument("--corpus-dir", required=True), x.add_argument("--output"), x.add_argument("--fields", **fields)
    x = sub.add_parser("align")
    x.add_argument("--model", required=True), x.add_argument("--base-vocab"), x.add_argument("--base-tokenizer"), x.add_argument("--corpus-dir"), x.add_argument("--output-dir", default="data"), x.add_argument("--sample-count", type=int, default=100), x.add_argument("--fields", **fields)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.program == "prepare":
            print(prepare(spark, a.input, a.output_dir, a.split, a.seed, not a.hash_split))
        elif a.program == "train":
            r = train(spark, a.input, a.output_dir, a.vocab_size, a.model_type, a.dry_run)
            print(reports.configuration(r) if a.dry_run else reports.vocabulary(r["vocab_size"], r["special_tokens"], r["merges"]))
        elif a.program == "eval":
            r = evaluate(spark, a.model, a.test_data, a.output, a.baseline, a.dry_run)
            print(r if a.dry_run else reports.summary(r))
        elif a.program == "retrain":
            r = retrain(spark, a.corpus_jsonl, a.output_dir, tuple(a.fields), a.vocab_size, a.old_model, a.install_to)
            n = r["new"]
            print(reports.retraining(r["vocab_size"], n["tokens_per_char"], n["single_tokens"], n["coverage"], n["passed"], n["total"]))
        elif a.program == "syntax":
            r = syntax(spark, a.model, a.train_text, a.corpus_dir, tuple(a.fields), a.output)
            print("\n".join(f"{t}: {n}" for t, n in sorted(r["vocab_hits"].items())), r["verdict"], sep="\n")
        else:
            print(align(spark, a.model, a.base_vocab, a.corpus_dir, tuple(a.fields), None, a.sample_count, a.output_dir, a.base_tokenizer)["recommendation"])
    except (UsageError, ValueError) as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
