"""Reports: rounding and formatting of one-row results on the driver, by Python's exact-binary rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..operators import metrics

TARGET = 1.8  # tokens per character at which a retrained model passes


def evaluation(df: DataFrame, own: str, base: str, vocab_size: int, source: str = "source") -> DataFrame:
    """One row: program_count, own and baseline stats, compression_ratio, vocab_utilization, fertility, vocab_size.

    One pass reduces the rows to a histogram of token counts by encoder, from which every statistic follows; the distinct
    pieces take another pass.
    """
    fertility = ratio(F.col("_own"), F.col("_chars"))
    counts = df.select(F.size(own).alias("_own"), F.size(base).alias("_base"), F.length(source).alias("_chars"))
    both = counts.select(F.inline(F.array(F.struct(F.lit(True).alias("own"), F.col("_own").alias("v"), fertility.alias("f")), F.struct(F.lit(False).alias("own"), F.col("_base").alias("v"), F.lit(None).cast("double").alias("f")))))
    h = both.groupBy("own", "v").agg(F.count("*").alias("k"), F.sum("f").alias("f"), F.count("f").alias("n_f"))
    by, everything = Window.partitionBy("own").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("own")
    h = h.withColumn("upto", F.sum("k").over(by)).withColumn("n", F.sum("k").over(everything))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("v")))
    last = F.col("n") - 1
    stats = h.groupBy("own").agg(
        F.max("n").alias("n"), F.sum(F.col("v") * F.col("k")).alias("total"), F.sum("f").alias("f"), F.sum("n_f").alias("n_f"),
        ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2.0).alias("median"), at(F.least(F.floor(F.col("n") * F.lit(0.95)), last)).cast("double").alias("p95"),
    )
    pick = lambda who, c: F.max(F.when(F.col("own") == F.lit(who), F.col(c)))
    none = lambda x: F.coalesce(x, F.lit(0.0))
    stat = lambda who: F.struct(none(ratio(pick(who, "total"), pick(who, "n"))).alias("mean"), none(pick(who, "median")).alias("median"), none(pick(who, "p95")).alias("p95"))
    main = stats.agg(
        F.coalesce(pick(True, "n"), F.lit(0)).alias("program_count"), stat(True).alias("own"), stat(False).alias("baseline"),
        none(ratio(pick(True, "total"), pick(False, "total"))).alias("compression_ratio"), none(ratio(pick(True, "f"), pick(True, "n_f"))).alias("fertility"),
    )
    out = main.join(F.broadcast(metrics.vocab_utilization(df, own, vocab_size)), F.lit(True))
    return out.select("program_count", "own", "baseline", "compression_ratio", "vocab_utilization", "fertility", F.lit(vocab_size).alias("vocab_size"))


def as_dict(report: DataFrame) -> dict:
    return report.first().asDict(recursive=True)


def summary(r: dict) -> str:
    return "\n".join([
        f"Programs evaluated:   {r['program_count']:>8}", f"Vocabulary size:      {r['vocab_size']:>8}",
        *(f"{name} tokens/program: mean {r[k]['mean']:.1f}, median {r[k]['median']:.1f}, p95 {r[k]['p95']:.1f}" for name, k in (("Own", "own"), ("Baseline", "baseline"))),
        f"Compression ratio:    {r['compression_ratio']:.4f}", f"Vocab utilization:    {r['vocab_utilization']:.4f}", f"Fertility:            {r['fertility']:.4f}",
    ])


def gate(tokens_per_char: Column, target: float = TARGET) -> Column:
    return F.when(tokens_per_char <= target, "PASS").otherwise("FAIL")


def retraining(vocab_size: int, ctr: float, single: dict[str, bool], coverage: float, passed: int, total: int, target: float = TARGET) -> str:
    ok = sum(single.values())
    return "\n".join([f"Vocabulary size: {vocab_size:,d}", f"Tokens per character: {ctr:.3f} ({'PASS' if ctr <= target else 'FAIL'}, target {target})", f"Single-token patterns: {ok}/{len(single)}", f"Coverage: {coverage:.2f} %", f"Round trip: {passed}/{total}"])


def configuration(config: dict) -> str:
    """A training configuration as lines of name and value."""
    return "\n".join(f"  {k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in config.items())


def vocabulary(vocab_size: int, special: int, merges: int) -> str:
    """The counts of a trained vocabulary; the reported merges are all ids but the special ones, the true ones are those learned."""
    return "\n".join([f"Vocabulary size: {vocab_size:,d}", f"Special tokens: {special}", f"Merges: {vocab_size - special:,d} reported, {merges:,d} learned"])


def mean_rounded(values: list[float], digits: int = 3) -> float | None:
    """The mean of the rounded values over 0, None without any."""
    over = [r for v in values if (r := round(v, digits)) > 0]
    return sum(over) / len(over) if over else None


def first_of(items: list[str], n: int) -> list[str]:
    return items[:n] + ([f"... and {len(items) - n} more"] if len(items) > n else [])


def alignment_markdown(overlap: dict, novel: list[str], compared: list[dict], expanded: list[dict], rec: dict, partial: bool) -> str:
    """Top 50 novel pieces and top 10 expansions, with the averages, the recommendation and what to do next."""
    out = ["# Vocabulary alignment", "", f"Partial: {'yes' if partial else 'no'}", "", "| measure | value |", "|---|---|", *(f"| {k} | {v:.2f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in overlap.items())]
    out += ["", "## Novel pieces", "", *first_of([f"- `{p}`" for p in novel], 50)]
    if compared:
        mean = lambda k: sum(c[k] for c in compared) / len(compared)
        out += ["", "## Samples", "", f"Average ratio: {mean_rounded([c['ratio'] for c in compared]) or 0:.3f} over {len(compared)} samples", f"Average tokens: own {mean('own_token_count'):.1f}, foreign {mean('base_token_count'):.1f}"]
    out += ["", "## Expansions", "", *first_of([f"- sample {e['sample_index']}: {e['ratio']:.3f} ({e['own_token_count']} to {e['base_token_count']} tokens)" for e in expanded], 10)]
    extend = rec["feasibility"] == "low"
    steps = ["Compare with a foreign vocabulary: this one was not at hand."] * partial + (["Add the most frequent novel pieces to the foreign vocabulary and measure again."] if extend else ["Train on the foreign tokenizer as it is."])
    return "\n".join([*out, "", "## Recommendation", "", f"{rec['action']} (feasibility {rec['feasibility']})", "", "## Next steps", "", *(f"{i}. {x}" for i, x in enumerate(steps, 1)), ""])
