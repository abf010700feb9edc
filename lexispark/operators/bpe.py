"""Byte-pair encoding: a distributed word histogram, a merge loop, lowest-rank-first encoding with byte fallback.

Merges are keyed by pair (Sennrich et al. 2016). Pre-tokens never cross a space, a newline, or a change between letters,
digits and other characters; user symbols are cut out first, longest first. A space is shown as U+2581 before a piece.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merging, tokenizers

SPACE = "▁"
WORDS = rf"{SPACE}?(?:[A-Za-z_]+|[0-9]+|[^A-Za-z_0-9\s{SPACE}]+)|{SPACE}|\n|[^\S\n]"
MODEL_TYPES = ("bpe", "unigram", "char", "word")


@dataclass(frozen=True)
class Config:
    input: str = ""
    model_prefix: str = ""
    model_type: str = "bpe"
    vocab_size: int = 8000
    character_coverage: float = 1.0
    user_defined_symbols: tuple[str, ...] = ("<STR>",)
    pad_id: int = -1
    unk_id: int = 0
    bos_id: int = 1
    eos_id: int = 2
    normalization_rule_name: str = "identity"
    add_dummy_prefix: bool = False
    remove_extra_whitespaces: bool = False
    byte_fallback: bool = True

    def as_dict(self) -> dict:
        return asdict(self) | {"user_defined_symbols": list(self.user_defined_symbols)}


def special_tokens(symbols: tuple[str, ...]) -> int:
    return 3 + len(symbols)


@dataclass
class Model:
    merges: list[tuple[str, str]] = field(default_factory=list)
    chars: list[str] = field(default_factory=list)
    symbols: tuple[str, ...] = ()
    scores: dict[str, float] = field(default_factory=dict)  # of a unigram model's pieces, the best first

    def pieces(self) -> list[str]:
        """By id: unknown, begin, end, symbols, 256 bytes, then merged pieces by rank and characters by frequency, or scored pieces."""
        return ["<unk>", "<s>", "</s>", *self.symbols, *(f"<0x{b:02X}>" for b in range(256)), *dict.fromkeys(a + b for a, b in self.merges), *self.chars, *self.scores]

    def first_learned(self) -> int:
        return 3 + len(self.symbols) + 256


def cut_symbols(text: str, symbols: tuple[str, ...]) -> list[tuple[str, bool]]:
    if not symbols:
        return [(text, False)]
    pattern = "(" + "|".join(re.escape(s) for s in sorted(symbols, key=len, reverse=True)) + ")"
    return [(part, i % 2 == 1) for i, part in enumerate(re.split(pattern, text)) if part]


def histogram(df: DataFrame, source: str = "source", symbols: tuple[str, ...] = ()) -> DataFrame:
    """(word, n) over all pre-tokens, natively."""
    c = F.replace(F.col(source), F.lit(" "), F.lit(SPACE))
    pattern = WORDS
    if symbols:
        cut = "|".join(re.escape(s) for s in sorted(symbols, key=len, reverse=True))
        c = F.regexp_replace(c, cut, "\n")
    return df.select(F.explode(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).alias("word")).filter("word <> '\n'").groupBy("word").agg(F.count("*").alias("n"))


def learn(words: Iterator[tuple[str, int]], n_merges: int, longest: int = 16) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges and characters by frequency. The most frequent pair goes first; ties by left, then right piece.

    In one process, with all words; `train` learns the same from words that stay with Spark's tasks (`merging.learn`).
    """
    chars: Counter[str] = Counter()
    seqs, freq = [], []
    for w, n in words:
        seqs.append(list(w))
        freq.append(n)
        for ch in w:
            chars[ch] += n
    count: Counter[tuple[str, str]] = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, s in enumerate(seqs):
        for p in zip(s, s[1:], strict=False):
            count[p] += freq[i]
            where[p].add(i)
    heap = [(-n, p) for p, n in count.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(merges) < n_merges:
        n, p = heapq.heappop(heap)
        if count.get(p, 0) != -n or n == 0 or len(p[0] + p[1]) > longest:
            continue
        merges.append(p)
        a, b = p
        ab = a + b
        changed: set[tuple[str, str]] = set()
        for i in where.pop(p):
            s, k, out, f = seqs[i], 0, [], freq[i]
            last = len(s) - 1
            while k <= last:
                if k == last or s[k] != a or s[k + 1] != b:
                    out.append(s[k])
                    k += 1
                    continue
                # the pairs on both sides of the merged one make way for those with the new piece
                if out:
                    old, new = (out[-1], a), (out[-1], ab)
                    count[old] -= f
                    count[new] += f
                    where[new].add(i)
                    changed |= {old, new}
                if k + 2 <= last:
                    old, new = (b, s[k + 2]), (ab, s[k + 2])
                    count[old] -= f
                    count[new] += f
                    where[new].add(i)
                    changed |= {old, new}
                out.append(ab)
                k += 2
            seqs[i] = out
        del count[p]
        for q in changed:
            if count[q] > 0:
                heapq.heappush(heap, (-count[q], q))
    return merges, [c for c, _ in sorted(chars.items(), key=lambda x: (-x[1], x[0]))]


def best_split(word: str, scores: dict[str, float], longest: int) -> list[str]:
    """The pieces of the greatest sum of scores; a character without a score stands alone, far below every piece."""
    worst = min(scores.values(), default=0.0) - 10.0
    best, cut = [0.0], [0]
    for e in range(1, len(word) + 1):
        top, at = best[e - 1] + scores.get(word[e - 1], worst), e - 1
        for s in range(max(0, e - longest), e - 1):
            v = scores.get(word[s:e])
            if v is not None and best[s] + v > top:
                top, at = best[s] + v, s
        best.append(top)
        cut.append(at)
    out, e = [], len(word)
    while e:
        out.append(word[cut[e] : e])
        e = cut[e]
    return out[::-1]


def learn_unigram(words: Iterator[tuple[str, int]], size: int, longest: int = 16, seeds: int = 8, keep: float = 0.75) -> dict[str, float]:
    """Log probabilities of at most `size` pieces, the best first, among them every character.

    Seeds are the substrings of the greatest count times length, `seeds` times as many as asked for. Each round splits
    every word at its best (hard expectation maximisation), counts the pieces, and keeps the most useful share.
    """
    words = [*words]
    chars: Counter[str] = Counter()
    subs: Counter[str] = Counter()
    for w, n in words:
        for ch in w:
            chars[ch] += n
        for s in range(len(w)):
            for e in range(s + 2, min(len(w), s + longest) + 1):
                subs[w[s:e]] += n
    if len(chars) > size:
        raise ValueError("vocabulary size too low for the corpus")
    some = sorted((p for p, n in subs.items() if n > 1), key=lambda p: (-subs[p] * len(p), p))[: seeds * size]
    count = {p: float(subs[p]) for p in some} | {c: float(n) for c, n in chars.items()}
    while True:
        total = math.log(sum(count.values()) or 1.0)
        scores = {p: math.log(n) - total for p, n in count.items()}
        if len(scores) <= size:
            return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0])))
        used: Counter[str] = Counter()
        for w, n in words:
            for p in best_split(w, scores, longest):
                used[p] += n
        room = max(size, int(len(scores) * keep)) - len(chars)
        long = sorted((p for p in scores if len(p) > 1), key=lambda p: (-used[p] * len(p), p))[:room]
        count = {p: max(used[p], 0.5) for p in long} | {c: max(used[c], 0.5) for c in chars}


def train(df: DataFrame, config: Config, source: str = "source") -> Model:
    """The histogram is counted in Spark; merges are learned where its words are, words and unigram pieces from a stream of them. ValueError if the corpus cannot fill the vocabulary."""
    if config.model_type not in MODEL_TYPES:
        raise ValueError(f"model type: {config.model_type}")
    counted = histogram(df, source, config.user_defined_symbols)
    words = ((r["word"], r["n"]) for r in counted.orderBy("word").toLocalIterator()) if config.model_type in ("word", "unigram") else iter(())
    base = special_tokens(config.user_defined_symbols) + 256
    if config.model_type == "word":
        top = sorted(words, key=lambda x: (-x[1], x[0]))[: max(0, config.vocab_size - base)]
        return Model([], [w for w, _ in top], config.user_defined_symbols)
    if config.model_type == "unigram":
        scores = learn_unigram(words, max(0, config.vocab_size - base))
        if len(scores) < config.vocab_size - base:
            raise ValueError("vocabulary size too high for the corpus")
        return Model([], [], config.user_defined_symbols, scores)
    merges, chars = merging.learn(counted, 0 if config.model_type == "char" else 1 << 30 if config.vocab_size <= 0 else max(0, config.vocab_size - base))
    room = config.vocab_size - base - len(chars)
    if room < 0 or config.model_type == "bpe" and len(merges) < room:
        raise ValueError("vocabulary size too high or too low for the corpus")
    return Model(merges[:room] if config.model_type == "bpe" else [], chars, config.user_defined_symbols)


class Encoder:
    """ids and pieces of texts; encodings of words are kept, since words repeat."""

    def __init__(self, model: Model) -> None:
        pieces = model.pieces()
        self.symbols, self.scores, self.id = model.symbols, model.scores, {}
        for i, p in enumerate(pieces):
            self.id.setdefault(p, i)
        self.pieces = pieces
        self.raw = {p: p.encode() for p in pieces} | {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
        self.rank = {p: i for i, p in enumerate(model.merges)}
        self.kept: dict[str, list[str]] = {}
        self.words = re.compile(WORDS)

    def word(self, w: str) -> list[str]:
        if w in self.kept:
            return self.kept[w]
        s = best_split(w, self.scores, max(map(len, self.scores))) if self.scores else self.merged(list(w))
        out = [q for p in s for q in ([p] if p in self.id else [f"<0x{b:02X}>" for b in p.encode()])]
        if len(self.kept) > 500_000:
            self.kept.clear()
        self.kept[w] = out
        return out

    def merged(self, s: list[str]) -> list[str]:
        """The pieces of a word's characters: the pair of least rank first, the leftmost of equals, from a heap of pairs."""
        rank, n = self.rank, len(s)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k) for k, p in enumerate(zip(s, s[1:], strict=False)) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if not s[k] or j < 0 or rank.get((s[k], s[j])) != r:
                continue  # one of the two was merged since
            s[k], s[j] = s[k] + s[j], ""
            after[k] = i = after[j]
            if i >= 0:
                before[i] = k
                if (r := rank.get((s[k], s[i]))) is not None:
                    heapq.heappush(heap, (r, k))
            h = before[k]
            if h >= 0 and (r := rank.get((s[h], s[k]))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in s if x]

    def encode(self, text: str) -> list[str]:
        out: list[str] = []
        for part, symbol in cut_symbols(text.replace(" ", SPACE), self.symbols):
            out += [part] if symbol else [q for w in self.words.findall(part) for q in self.word(w)]
        return out

    def decode(self, pieces: list[str]) -> str:
        raw = b"".join(map(self.raw.__getitem__, pieces))
        return raw.decode("utf-8", "replace").replace(SPACE, " ")


def encode(df: DataFrame, model: Model, source: str = "source", decode: bool = True) -> DataFrame:
    """df with ids, pieces and, if asked for, decoded. A task encodes each word it has met once."""
    kinds = "ids:array<int>,pieces:array<string>" + ",decoded:string" * decode

    @F.pandas_udf(f"struct<{kinds}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = Encoder(model)
        for s in tokenizers.slices(batches):
            p = [e.encode(t) for t in s]
            out = {"ids": [[*map(e.id.__getitem__, y)] for y in p], "pieces": p}
            yield pd.DataFrame(out | ({"decoded": [e.decode(y) for y in p]} if decode else {}))

    return df.withColumn("_e", run(F.col(source))).select(*df.columns, "_e.*")


def save(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame(list(enumerate(model.pieces())), "id int, piece string").write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(model.merges)], "rank int, a string, b string").write.mode("overwrite").parquet(f"{path}/merges")
    spark.createDataFrame([("char", i, c) for i, c in enumerate(model.chars)] + [("symbol", i, s) for i, s in enumerate(model.symbols)], "kind string, at int, piece string").write.mode("overwrite").parquet(f"{path}/base")


    spark.createDataFrame([*map(tuple, model.scores.items())], "piece string, score double").write.mode("overwrite").parquet(f"{path}/scores")


def load(spark: SparkSession, path: str) -> Model:
    merges = [(r["a"], r["b"]) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    base = spark.read.parquet(f"{path}/base").orderBy("at").collect()
    return Model(merges, [r["piece"] for r in base if r["kind"] == "char"], tuple(r["piece"] for r in base if r["kind"] == "symbol"), {r["piece"]: r["score"] for r in spark.read.parquet(f"{path}/scores").orderBy(F.desc("score"), "piece").collect()})


def pair_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """(a, b, n) of all neighbouring characters within the words of the histogram."""
    w = histogram(df, source)
    pairs = w.filter("length(word) > 1").select("n", F.posexplode(F.sequence(F.lit(1), F.length("word") - 1)).alias("p", "i"), "word")
    return pairs.select("n", F.expr("substring(word, i, 1)").alias("a"), F.expr("substring(word, i + 1, 1)").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))
