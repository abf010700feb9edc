"""Tokenizer files, line numbers over file splits, unigram models, the whole alignment and retraining reports."""

import json
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexispark import scan_queries
from lexispark.operators import bpe, tokenizers
from lexispark.plans import pipelines, reports
from lexispark.sources import scans


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    n = 2000
    f = tmp_path / "m.vocab"
    f.write_text("".join(f"piece{i}\t-{i}\n" for i in range(n)))
    rows = scans.read_vocab_tsv(spark, str(f))
    assert rows.rdd.getNumPartitions() > 1
    assert {r.id: (r.piece, r.score) for r in rows.collect()} == {i: (f"piece{i}", float(-i)) for i in range(n)}
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.jsonl").write_text("\n".join("" if i % 5 == 0 else f"bad {i}" if i % 7 == 0 else json.dumps({"tk_source": f"text {i}"}) for i in range(n)))
    good, bad = scans.read_jsonl(spark, str(tmp_path / "in"))
    assert sorted((r.line_no, r.raw) for r in bad.collect()) == sorted(2 * [(i + 1, f"bad {i}") for i in range(n) if i % 5 and i % 7 == 0])
    assert good.count() == 2 * sum(1 for i in range(n) if i % 5 and i % 7)


def test_programs_over_splits(spark, tmp_path, small_splits):
    r = random.Random(5)
    text = "".join(r.choice(["a", "b c", "\n", "\n\n", "\r\n\r\n", "\r\n", " ", "\n \n", "x" * 30]) for _ in range(9000))
    f = tmp_path / "p.txt"
    f.write_bytes(text.encode())
    want = [x for b in text.replace("\r\n", "\n").split("\n\n") if (x := b.strip())]
    assert [x.source for x in scans.read_programs(spark, str(f)).orderBy("ord").collect()] == want


def test_merges_by_heap():
    r = random.Random(2)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 12))): r.randint(1, 9) for _ in range(60)}
    merges, chars = bpe.learn(iter(sorted(words.items())), 40)
    e = bpe.Encoder(bpe.Model(merges, chars))
    for _ in range(200):
        w = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        s = list(w)
        while len(s) > 1:
            rank, k = min((e.rank.get(p, 1 << 30), k) for k, p in enumerate(zip(s, s[1:], strict=False)))
            if rank == 1 << 30:
                break
            s[k : k + 2] = [s[k] + s[k + 1]]
        assert e.merged(list(w)) == s


def test_unigram(spark, tmp_path):
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "aba": -2.4, "ba": -3.0}

    def splits(w):
        yield from ([w[:i], *rest] for i in range(1, len(w) + 1) for rest in splits(w[i:])) if w else [[]]

    for w in ("a", "abab", "ababba", "bbaab"):
        best = max(sum(scores[p] for p in s) for s in splits(w) if all(p in scores for p in s))
        assert sum(scores[p] for p in bpe.best_split(w, scores, 3)) == pytest.approx(best)
    texts = ["the cat the cat sat", "the hat that sat", "", "ein Tag é 😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, source string")
    model = bpe.train(df, bpe.Config(model_type="unigram", vocab_size=256 + 4 + 30))
    assert len(model.pieces()) == 290 and any(len(p) > 1 for p in model.scores)
    bpe.save(spark, model, str(tmp_path / "u"))
    assert bpe.load(spark, str(tmp_path / "u")) == model
    got = bpe.encode(df, model).orderBy("ord").collect()
    assert [r.decoded for r in got] == texts and len(got[0].pieces) < len(texts[0])
    with pytest.raises(ValueError, match="too high"):
        bpe.train(df, bpe.Config(model_type="unigram", vocab_size=9000))
    with pytest.raises(ValueError, match="too low"):
        bpe.train(df, bpe.Config(model_type="unigram", vocab_size=262))


def test_tokenizer_files(spark):
    sentencepiece, tiktoken = pytest.importorskip("sentencepiece"), pytest.importorskip("tiktoken")
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()] + ["", "é 😀\n\n x"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, source string")
    sp = sentencepiece.SentencePieceProcessor(model_file=scan_queries.tokenizer_file("piece_bpe_32k.model"))
    ranks = tokenizers.load_ranks(scan_queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    bytes_of = {i: b for b, i in ranks.items()}
    for name, encode in (("piece_bpe_32k.model", sp.encode), ("byte_bpe_50k.tiktoken", tiktoken.Encoding("x", pat_str=tokenizers.RANKS_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)):
        pieces, column = tokenizers.open_tokenizer(scan_queries.tokenizer_file(name))
        got = df.select("ord", column(F.col("source")).alias("e")).orderBy("ord").collect()
        assert [r.e.ids for r in got] == [encode(t) for t in texts]
        assert all(set(r.e.pieces) <= set(pieces) for r in got)
        if name.endswith("tiktoken"):
            assert [r.e.decoded for r in got] == texts and all(b"".join(bytes_of[i] for i in r.e.ids) == t.encode() for r, t in zip(got, texts, strict=True))
        else:
            assert [r.e.pieces for r in got] == [sp.encode(t, out_type=str) for t in texts]
    assert tokenizers.open_tokenizer("/none.tiktoken") is None and tokenizers.open_tokenizer("/none.txt") is None


def test_evaluate_and_align_with_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    sources = [f"let a{i}=sum({i});\nm=$i64 y{'x' * (i % 7)}" for i in range(60)]
    (tmp_path / "c/x.jsonl").write_text("\n".join(json.dumps({"tk_source": s}) for s in [*sources, sources[0]]))
    (tmp_path / "p.txt").write_text("\n\n".join(sources))
    run = lambda *a: pipelines.main(list(map(str, a)), spark)
    ranks, piece = scan_queries.tokenizer_file("byte_bpe_50k.tiktoken"), scan_queries.tokenizer_file("piece_bpe_32k.model")
    assert run("eval", "--model", piece, "--test-data", tmp_path / "p.txt", "--baseline", ranks, "--output", tmp_path / "e.json") == 0
    r = json.loads((tmp_path / "e.json").read_text())
    assert r["program_count"] == 60 and r["vocab_size"] == 32000
    assert run("eval", "--model", piece, "--test-data", tmp_path / "p.txt", "--baseline", tmp_path / "none.tiktoken") == 1
    assert run("retrain", "--corpus-jsonl", tmp_path / "c/x.jsonl", "--output-dir", tmp_path / "n", "--vocab-size", 310, "--install-to", tmp_path / "reg/model") == 0
    r = json.loads((tmp_path / "n/retrain.json").read_text())
    text = (tmp_path / "n/data/train.txt").read_text()
    assert r["training_bytes"] == len(text.encode()) and text == "\n\n".join(sources) + "\n" and r["installed"] and (tmp_path / "reg/model").is_dir()
    assert r["new"]["roundtrip"] == "60/60" and r["patterns"]["m="] == {"is_single_token": True, "pieces": ["m="]} and round(r["new"]["tokens_per_char"], 4) == r["new"]["tokens_per_char"]
    assert run("align", "--model", tmp_path / "n/model", "--base-tokenizer", piece, "--corpus-dir", tmp_path / "c", "--output-dir", tmp_path / "a", "--sample-count", 20) == 0
    a = json.loads((tmp_path / "a/alignment.json").read_text())
    ratios = [s["ratio"] for s in a["samples"]]
    assert a["partial"] is False and len(ratios) == 20 and a["recommendation"]["average_ratio"] == round(sum(ratios) / 20, 3)
    assert "Next steps" in (tmp_path / "a/alignment.md").read_text() and "Average tokens" in (tmp_path / "a/alignment.md").read_text()
    assert run("align", "--model", tmp_path / "n/model", "--base-tokenizer", tmp_path / "none.json", "--output-dir", tmp_path / "a") == 0
    assert json.loads((tmp_path / "a/alignment.json").read_text())["partial"] is True
    out = tmp_path / "h"
    assert run("prepare", "--input", tmp_path / "c/x.jsonl", "--output-dir", out, "--hash-split") == 0
    assert scans.read_programs(spark, str(out / "train.txt")).count() == 54 and scans.read_programs(spark, str(out / "valid.txt")).count() == 6
    assert run("train", "--input", tmp_path / "p.txt", "--output-dir", tmp_path / "u", "--vocab-size", 310, "--model-type", "unigram") == 0


def test_report_texts():
    assert reports.mean_rounded([0.0, 1.2344, 1.2346]) == (1.234 + 1.235) / 2 and reports.mean_rounded([0.0]) is None
    assert reports.first_of(["a", "b", "c"], 2) == ["a", "b", "... and 1 more"]
    assert "7,996 reported" in reports.vocabulary(8000, 4, 100)
    assert "symbols: <STR>" in reports.configuration(bpe.Config().as_dict())
