"""Token counts under a unigram model: forward scores are computed once per prefix that distinct pre-tokens share.

The model is the piece list of a public vocabulary file with a score for each piece, in millionths of a nat. A caller
with a unigram table gives its scores; the installed files hold none (theirs are ranks of merges), so by default a piece
gets the score of Zipf's law for its rank: -round(1e6 * ln(rank + 2)). That is an assumption, and the counts are those
of this model, not of the file's own tokenizer. A character that no piece covers costs one token per UTF-8 byte, each at
the least piece's score less ten nats. The best sum wins; ties go to fewer tokens, so a count is always defined.
Pre-tokens are the runs of bytes other than ASCII white space, each with the vocabulary's word mark before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

MARK = "▁"


class PrefixCounts:
    """The trie of pre-tokens, visited in sorted order, so that only the path to the last one is held.

    best[i] and count[i] belong to the trie node of the first i characters. A following pre-token reuses those of the
    prefix that it shares and computes the rest; terminal counts are kept by pre-token.
    """

    def __init__(self, pieces: list[str], scores: dict[str, int] | None = None) -> None:
        self.scores = dict(scores or {})
        for rank, piece in enumerate(pieces if scores is None else ()):
            self.scores.setdefault(piece, -round(1e6 * math.log(rank + 2)))
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = (min(self.scores.values()) if scores else -round(1e6 * math.log(len(pieces) + 2))) - 10_000_000
        self.terminal: dict[bytes, int] = {}
        self.nodes = 0

    def insert(self, words: list[bytes]) -> None:
        """Terminal counts of distinct pre-tokens."""
        scores, longest = self.scores, self.longest
        path, best, count = "", [0], [0]
        for raw in sorted(words):
            word = MARK + raw.decode("utf-8", "replace")
            i = 0
            for i, (x, y) in enumerate(zip(path, word, strict=False), 1):  # noqa: B007
                if x != y:
                    i -= 1
                    break
            del best[i + 1 :], count[i + 1 :]
            for e in range(i + 1, len(word) + 1):
                n = len(word[e - 1].encode("utf-8", "replace"))
                top, few = best[e - 1] + n * self.unknown, count[e - 1] + n
                for s in range(e - 1, max(-1, e - 1 - longest), -1):
                    v = scores.get(word[s:e])
                    if v is not None:
                        v += best[s]
                        if v > top or v == top and count[s] + 1 < few:
                            top, few = v, count[s] + 1
                best.append(top)
                count.append(few)
            self.nodes += len(word) - i
            path = word
            self.terminal[raw] = count[-1]

    def counts(self, texts: list[str | None], most: int = 300_000) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text. The terminal table is dropped when it holds over `most` pre-tokens."""
        if len(self.terminal) > most:
            self.terminal.clear()
        out, step = [], 4096
        for at in range(0, len(texts), step):
            split = [(t or "").encode().split() for t in texts[at : at + step]]
            new = set().union(*split) - self.terminal.keys() if split else set()
            if new:
                self.insert(list(new))
            get = self.terminal.__getitem__
            out += [(len(w), sum(map(get, w))) for w in split]
            if len(self.terminal) > most:
                self.terminal.clear()
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_loaded: dict[str, PrefixCounts] = {}


def model(path: str) -> PrefixCounts:
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = PrefixCounts([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])
    return _loaded[path]


def token_counts(documents: DataFrame, path: str | None = None, scores: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text; null and blank texts count 0; repeated rows each give a row, an empty table none.

    scores, if given, are those of all pieces, in millionths of a nat. One pass, nothing shuffled: a task holds the
    terminal counts of its own distinct pre-tokens, a bounded number.
    """
    path = path or default_path()
    small_batches(documents.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path) if scores is None else PrefixCounts([], scores)
        for b in batches:
            got = np.array(m.counts(b.column(1).to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["doc_id", "n_pretokens", "n_tokens"])

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(rows, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
