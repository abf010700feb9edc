"""Tokenizers as column expressions or Arrow kernels: each adds pieces (and ids where it has them)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REGEX = r"[A-Za-z_]+|[0-9]+|[^ \t\r\nA-Za-z_0-9]"


def regex_pieces(c: Column, pattern: str = REGEX) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def char_pieces(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def byte_pieces(c: Column) -> Column:
    """Byte pieces spelled <0x..>."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(c, "utf-8")), F.lit(".."), F.lit(0)), lambda x: F.concat(F.lit("<0x"), x, F.lit(">")))


PIECES = {"regex": regex_pieces, "char": char_pieces, "byte": byte_pieces}


RANKS_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
Encode = Callable[[Column], Column]


def slices(batches: Iterator[pd.Series], most: int = 1 << 20) -> Iterator[pd.Series]:
    """The texts of batches, null as empty, in series of about `most` characters: tokens of a whole batch would not fit a worker."""
    for s in batches:
        s, first, n = s.fillna(""), 0, 0
        for i, t in enumerate(s, 1):
            n += len(t)
            if n >= most or i == len(s):
                yield s.iloc[first:i]
                first, n = i, 0


def sentencepiece_encoder(path: str, ids_only: bool = False) -> Encode:
    """A function of a text column giving struct<ids, pieces, decoded>, or struct<ids>; the model is loaded once per Python worker."""

    @F.pandas_udf("struct<ids:array<int>" + ",pieces:array<string>,decoded:string" * (not ids_only) + ">")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        for s in slices(batches):
            ids = sp.encode(s.tolist(), num_threads=1)
            yield pd.DataFrame({"ids": ids} if ids_only else {"ids": ids, "pieces": [[*map(spelled.__getitem__, x)] for x in ids], "decoded": sp.decode(ids)})

    return encode


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines with a token in base 64 and its rank."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_file_encoder(path: str, pattern: str = RANKS_PATTERN) -> Encode:
    """The same for a file of byte-pair ranks; pieces are spelled as bytes in Latin-1."""

    @F.pandas_udf("struct<ids:array<int>,pieces:array<string>,decoded:string>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = load_ranks(path)
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        spelled = {i: b.decode("latin-1") for b, i in ranks.items()}
        for s in slices(batches):
            ids = [enc.encode_ordinary(t) for t in s]
            yield pd.DataFrame({"ids": ids, "pieces": [[*map(spelled.__getitem__, x)] for x in ids], "decoded": [enc.decode(x) for x in ids]})

    return encode


def vocabulary_file_encoder(path: str) -> Encode:
    """The same for a tokenizer file in JSON, without special tokens."""

    @F.pandas_udf("struct<ids:array<int>,pieces:array<string>,decoded:string>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import tokenizers

        t = tokenizers.Tokenizer.from_file(path)
        for s in slices(batches):
            e = [t.encode(x, add_special_tokens=False) for x in s]
            yield pd.DataFrame({"ids": [x.ids for x in e], "pieces": [x.tokens for x in e], "decoded": [t.decode(x.ids, skip_special_tokens=False) for x in e]})

    return encode


def available(module: str) -> bool:
    """Whether an optional library can be imported; callers give a partial result where it cannot."""
    from importlib.util import find_spec

    return find_spec(module) is not None


#: what a tokenizer file's ending asks for: the library, its encoder, its pieces
KINDS = {
    ".model": ("sentencepiece", sentencepiece_encoder, lambda lib, path: (lambda sp: [sp.id_to_piece(i) for i in range(sp.get_piece_size())])(lib.SentencePieceProcessor(model_file=path))),
    ".tiktoken": ("tiktoken", rank_file_encoder, lambda lib, path: [b.decode("latin-1") for b in load_ranks(path)]),
    ".json": ("tokenizers", vocabulary_file_encoder, lambda lib, path: sorted(lib.Tokenizer.from_file(path).get_vocab())),
}


def open_tokenizer(path: str) -> tuple[list[str], Encode] | None:
    """(pieces, encoder) of a local tokenizer file by its ending; None where the library or a readable file is missing.

    Code that comes with a tokenizer is never run.
    """
    from importlib import import_module

    kind = KINDS.get(path[path.rfind(".") :])
    if not kind or not available(kind[0]):
        return None
    try:
        return kind[2](import_module(kind[0]), path), kind[1](path)
    except Exception:  # noqa: BLE001  each library has errors of its own
        return None
