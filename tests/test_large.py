"""What must hold on larger tables: words stay with the tasks, tokens of a batch come in slices, no file is one row."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexispark import queries, scan_queries
from lexispark.operators import bpe, merging, patterns, tokenizers
from tests.conftest import SF


@pytest.mark.parametrize("letters, n, longest", [("ab", 1 << 30, 16), ("abcdefg", 40, 16), ("aé😀▁", 30, 4), ("", 5, 16)])
def test_merges_of_spread_words(spark, letters, n, longest):
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, 20))): r.randint(1, 9) for _ in range(80 if letters else 0)}
    got = merging.learn(spark.createDataFrame([*words.items()], "word string, n long"), n, longest)
    assert got == bpe.learn(iter(sorted(words.items())), n, longest)


@pytest.mark.parametrize("query", ["bpe_merges", "bpe_roundtrip"])
def test_words_stay_off_the_driver(spark, monkeypatch, query):
    def refuse(*a, **k):
        raise AssertionError("rows are streamed to the driver")

    docs = queries.docs(spark, SF)
    config = bpe.Config()
    monkeypatch.setattr(type(docs), "toLocalIterator", refuse)
    monkeypatch.setattr(bpe, "learn", refuse)
    assert queries.QUERIES[query](spark, SF).count()
    if query == "bpe_merges":
        monkeypatch.undo()
        words = [tuple(x) for x in bpe.histogram(docs, symbols=config.user_defined_symbols).collect()]
        merges, chars = bpe.learn(iter(words), config.vocab_size - 4 - 256)
        got = queries.bpe_merges(spark, SF).orderBy("rank").collect()
        assert [(x["a"], x["b"]) for x in got] == merges[: config.vocab_size - 4 - 256 - len(chars)]


def test_tokens_come_in_slices():
    batch = pd.Series(["a" * 400_000, None, "b" * 700_000, "", "c" * 3_000_000, "d"])
    parts = [*tokenizers.slices(iter([batch, pd.Series([], dtype=object), pd.Series(["e"])]))]
    assert [len(p) for p in parts] == [3, 2, 1, 1]
    assert pd.concat(parts).tolist() == [*batch.fillna(""), "e"]


@pytest.mark.parametrize("model", ["piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "own"])
def test_encoders_yield_slices(spark, model):
    df = spark.createDataFrame([(i, "m=1 the sum " * n) for i, n in enumerate((0, 40_000, 3, 70_000, 90_000, 1))], "ord int, source string").coalesce(1)
    if model == "own":
        m = bpe.train(df, bpe.Config(vocab_size=300, model_type="char"))
        e = bpe.encode(df, m).select("ord", "source", "decoded")
    else:
        _, encode = tokenizers.open_tokenizer(scan_queries.tokenizer_file(model))
        e = df.withColumn("_e", encode(F.col("source"))).select("ord", "source", F.col("_e.decoded"))
    assert {r["ord"] for r in e.collect() if r["decoded"].strip() == r["source"].strip()} == set(range(6))


def test_counts_of_files_by_line(spark, tmp_path):
    texts = ["", "\n", "m=$x", "m=$x\r\n@(\n", "﻿M=\n$é", "﻿M=\n$$😀\n", "\n\n I=F=", "a\rb\x0bc\x85d T=\n"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
        got, want = (f.first() for f in (patterns.file_syntax_counts(spark, str(tmp_path / f"{i}.txt")), patterns.syntax_counts(spark.createDataFrame([(t,)], "source string"))))
        assert got == want, (t, got, want)
    got, want = (f.first() for f in (patterns.file_syntax_counts(spark, str(tmp_path)), patterns.syntax_counts(spark.createDataFrame([(t,) for t in texts], "source string"))))
    assert got == want


def test_no_file_is_one_row(spark):
    plan = scan_queries.whole_text(spark, SF)._jdf.queryExecution().toString()
    assert "wholetext" not in plan.lower()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert scan_queries.whole_text(spark, SF).first()["chars"] > 100_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
