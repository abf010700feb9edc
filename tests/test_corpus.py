import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexispark.operators import alignment, bpe, corpus, metrics, patterns, tokenizers
from lexispark.plans import pipelines, reports
from lexispark.sources import scans, sinks


def rows(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "ord bigint, source string")


@pytest.mark.parametrize(("given", "wanted"), [(["abc", "def", "abc", "ghi", "def"], ["abc", "def", "ghi"]), (["c", "a", "b", "a"], ["c", "a", "b"]), ([], []), (["x"] * 4, ["x"])])
def test_dedup(spark, given, wanted):
    assert [r.source for r in corpus.dedup_first(rows(spark, given)).orderBy("ord").collect()] == wanted
    n = corpus.dedup_counts(rows(spark, given)).first()
    assert (n.total, n.unique_rows, n.removed) == (len(given), len(wanted), len(given) - len(wanted))


@pytest.mark.parametrize("n", [0, 1, 50, 100])
def test_splits(spark, n):
    df = rows(spark, [f"t{i}" for i in range(n)])
    order = list(range(n))
    random.Random(42).shuffle(order)
    exact = corpus.split_exact(df, 0.9).orderBy("pos").collect()
    assert [r.ord for r in exact] == order
    assert sum(r.split == "train" for r in exact) == int(n * 0.9)
    hashed = corpus.split_by_hash(df, 0.9)
    assert hashed.filter("split = 'train'").count() == int(n * 0.9)
    assert sorted(map(tuple, corpus.split_by_hash(df, 0.9).collect())) == sorted(map(tuple, hashed.collect()))


def test_sample_exact(spark):
    got = corpus.sample_exact(rows(spark, [str(i) for i in range(30)]), 7).orderBy("pos").collect()
    assert [r.ord for r in got] == random.Random(42).sample(range(30), 7)


def test_jsonl(spark, tmp_path):
    lines = ['{"tk_source": "a"}', "not json", "", '{"x": 1}', '{"tk_source": " "}', '{"tk_source": ""}', '{"tk_source": 5}', '{"tk_source": "b"} junk', "{'tk_source': 'q'}", '{"tk_source":"old","tk_source":"new"}', "[1]", '{"tk_source": NaN}']
    f = tmp_path / "c.jsonl"
    f.write_text("\n".join(lines))
    good, bad = scans.read_jsonl(spark, str(f), strict=True)
    assert [r.source for r in good.orderBy("ord").collect()] == ["a", " ", "new"]
    assert bad.count() == 8
    both = tmp_path / "f.jsonl"
    both.write_text("\n".join(['{"a": "", "b": " x "}', '{"a": 3, "b": "x"}', '{"a": " ", "b": "x"}', '{"b": "y"}', '{"a": []}']))
    assert [r.source for r in scans.read_fallback_jsonl(spark, str(both), ("a", "b")).orderBy("ord").collect()] == ["x", "y"]


def test_directory_order(spark, tmp_path):
    for name, text in (("a/b.json", "1"), ("a-b/c.json", "2"), ("a.json", "3"), ("manifest.json", "4"), ("z/q.jsonl", "5")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps({"tk_source": text}))
    got = lambda first, n=None: [r.source for r in scans.read_directory(spark, str(tmp_path), ("tk_source",), first, n).orderBy("ord").collect()]
    assert got(True) == ["1", "2", "3", "5"]
    assert got(False) == ["5", "1", "2", "3"]
    assert got(True, 2) == ["1", "2"]


def test_program_text(spark, tmp_path):
    f = str(tmp_path / "p.txt")
    assert sinks.write_program_text(rows(spark, ["M=a;  \n", "x\n\ny"]), f) == 2
    assert Path(f).read_text() == "M=a;  \n\nx\n\ny\n"
    assert [r.source for r in scans.read_programs(spark, f).orderBy("ord").collect()] == ["M=a;", "x", "y"]
    sinks.write_program_text(rows(spark, []), f)
    assert Path(f).read_text() == "\n"
    assert scans.read_programs(spark, f).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 20, 40, 100])
def test_p95(spark, n):
    r = random.Random(n)
    values = [r.randint(0, 50) for _ in range(n)]
    got = metrics.p95(spark.createDataFrame([(v,) for v in values], "v int"), "v").first().p95
    assert got == (float(sorted(values)[min(int(n * 0.95), n - 1)]) if n else 0.0)


def test_ratios(spark):
    df = spark.createDataFrame([("abcd", [1, 2], [1, 2, 3, 4]), ("", [], [])], "source string, own array<int>, base array<int>")
    r = df.agg(metrics.compression_ratio(F.size("own"), F.size("base")).alias("c"), metrics.fertility(F.col("own"), F.col("source")).alias("f"), metrics.coverage_percent(F.col("own"), 1).alias("k"), metrics.corpus_chars(F.col("source")).alias("n")).first()
    assert (r.c, r.f, r.k, r.n) == (0.5, 0.5, 50.0, 7)
    none = df.limit(0).agg(metrics.compression_ratio(F.size("own"), F.size("base")).alias("c"), metrics.coverage_percent(F.col("own"), 1).alias("k")).first()
    assert (none.c, none.k) == (0.0, 100.0)
    assert metrics.vocab_utilization(df, "own", 4).first().vocab_utilization == 0.5
    assert metrics.vocab_utilization(df, "own", 0).first().vocab_utilization == 0.0


def test_report(spark):
    df = spark.createDataFrame([("abcdef", ["a"] * 3, ["b"] * 6)], "source string, own array<string>, base array<string>")
    r = reports.as_dict(reports.evaluation(df, "own", "base", 100))
    assert (r["program_count"], r["compression_ratio"], r["fertility"], r["vocab_utilization"]) == (1, 0.5, 0.5, 0.01)
    assert "0.5000" in reports.summary(r)


def brute_bpe(words, n):
    seqs = {w: list(w) for w in words}
    out = []
    for _ in range(n):
        c = {}
        for w, k in words.items():
            for p in zip(seqs[w], seqs[w][1:], strict=False):
                c[p] = c.get(p, 0) + k
        c = {p: k for p, k in c.items() if len(p[0] + p[1]) <= 16}
        if not c:
            break
        best = min(c, key=lambda p: (-c[p], p))
        out.append(best)
        for w, s in seqs.items():
            t, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == best:
                    t.append(s[i] + s[i + 1])
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            seqs[w] = t
    return out


def test_bpe(spark):
    words = {"aaaa": 3, "abab": 2, "cab": 2, "bca": 1}
    assert bpe.learn(iter(sorted(words.items())), 6)[0] == brute_bpe(words, 6)
    texts = ["let a=sum=3 aaaa\n$x", "", "é 😀 b", "m=1;m=2"]
    model = bpe.train(rows(spark, ["m=1;m=2 aaaa aaaa", "let a sum let"]), bpe.Config(vocab_size=256 + 3 + 2 + 20, user_defined_symbols=("m=", "<STR>")))
    got = bpe.encode(rows(spark, texts), model).orderBy("ord").collect()
    assert [r.decoded for r in got] == texts
    assert "m=" in got[0].pieces and "<0x24>" in got[0].pieces
    assert all(0 not in r.ids for r in got)
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.train(rows(spark, ["ab"]), bpe.Config(vocab_size=100_000))


def test_patterns_and_alignment(spark):
    checked = patterns.single_tokens(patterns.catalogue(spark), tokenizers.regex_pieces(F.col("pattern")))
    r = patterns.rates(checked).first()
    assert (r.new_total, r.old_total) == (13, 12)
    own, base = spark.createDataFrame([("a",), ("b",), ("c",), ("",)], "piece string"), spark.createDataFrame([("b",), ("d",)], "piece string")
    o = alignment.vocab_overlap(own, base)
    assert (o.first().shared, o.first().novel, o.first().jaccard) == (1, 2, 0.25)
    assert [r.piece for r in alignment.novel_pieces(own, base).collect()] == ["a", "c"]
    empty = alignment.recommendation(alignment.vocab_overlap(own, base.limit(0)), True).first()
    assert (empty.novel_pct, empty.action, empty.partial) == (100.0, "vocab_extension_prototype", True)
    c = spark.createDataFrame([(0, 1.5, 2, 3, ""), (1, 2.0, 2, 4, ""), (2, 2.0, 1, 2, "")], "sample_index int, ratio double, own_token_count int, base_token_count int, source_preview string")
    assert [r.sample_index for r in alignment.expansions(c).collect()] == [1, 2]


def test_programs_end_to_end(spark, tmp_path):
    src, out = tmp_path / "c.jsonl", tmp_path / "data"
    lines = [json.dumps({"tk_source": f'M=mod{i};\nlet s="hello{i}";'}) for i in range(20)]
    src.write_text("\n".join([*lines, lines[0]]))
    run = lambda *a: pipelines.main(list(map(str, a)), spark)
    assert run("prepare", "--input", src, "--output-dir", out) == 0
    train = (out / "train.txt").read_text()
    assert train.count("M=mod") == 18 and (out / "valid.txt").read_text().count("M=mod") == 2 and '"<STR>"' in train
    assert run("prepare", "--input", tmp_path / "none", "--output-dir", out) == 1
    m = tmp_path / "m"
    assert run("train", "--input", out / "train.txt", "--output-dir", m, "--dry-run") == 0 and not m.exists()
    assert run("train", "--input", out / "train.txt", "--output-dir", m, "--vocab-size", "-1") == 1
    assert run("train", "--input", out, "--output-dir", m) == 1
    assert run("train", "--input", out / "train.txt", "--output-dir", m, "--vocab-size", 290) == 0
    assert run("eval", "--model", m / "model", "--test-data", out / "valid.txt", "--output", tmp_path / "r.json") == 0
    assert json.loads((tmp_path / "r.json").read_text())["program_count"] == 2
    assert run("eval", "--model", m / "model", "--test-data", tmp_path / "none") == 1
    assert run("retrain", "--corpus-jsonl", src, "--output-dir", tmp_path / "n", "--old-model", m / "model", "--vocab-size", 310) == 0
    assert run("syntax", "--model", m / "model", "--train-text", out / "train.txt", "--corpus-dir", tmp_path, "--output", tmp_path / "s.json") == 0
    assert run("align", "--model", m / "model", "--output-dir", tmp_path / "a") == 0
    assert json.loads((tmp_path / "a/alignment.json").read_text())["partial"] is True
    with pytest.raises(SystemExit):
        pipelines.main(["train", "--input", "x", "--output-dir", "y", "--model-type", "other"], spark)


def test_stream(spark, tmp_path):
    from lexispark.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text('{"tk_source": "a \\"x\\""}\n{"tk_source": "a \\"y\\""}\nbad\n{"tk_source": "b"}\n')
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.source for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ['a "<STR>"', "b"]
