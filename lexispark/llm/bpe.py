"""Byte-level BPE by content-defined chunks: a chunk that documents share is encoded once, and chunk joins are repaired.

A rolling hash of the last bytes cuts each text where its low bits vanish, so equal passages give equal chunks wherever
they stand. Each task keeps the ids of the chunks it has met (bounded, oldest out) and encodes only new ones. A cut may
fall inside a pre-token. An edge between a character that is no white space and one that is, is a pre-token edge
whatever surrounds it; so at each join the stretch between the nearest such edges on both sides is encoded again, and
outside it both encodings agree. A chunk without such an edge is joined with its neighbour and encoded as one.
Spilling every chunk's ids through a shuffle to encode once per cluster instead of once per task would move more bytes
than the texts hold, so reuse is by task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WINDOW = 16
MASK_BITS = 10
LEAST = 256
BLANK = " \t\n\r"
EDGE = re.compile(r"\S(?=[ \t\n\r])")


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """encode and decode as the tokenizer file says; only byte-level BPE files with rank-ordered ids are accepted."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = {i: p for p, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.lengths = np.zeros(max(self.pieces) + 1, np.int64)
        for i, p in self.pieces.items():
            self.lengths[i] = len(p)
        self.kept: dict[bytes, np.ndarray] = {}
        self.kept_bytes = 0
        self.reused = self.encoded = 0
        rng = np.random.RandomState(7)
        self.gear = rng.randint(0, 1 << 62, 256).astype(np.uint64)

    def raw(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint32) if text else np.zeros(0, np.uint32)

    def cuts(self, data: bytes) -> list[int]:
        """Chunk ends: where the rolling hash over WINDOW bytes has MASK_BITS zero bits, at character starts, LEAST apart."""
        if len(data) <= 2 * LEAST:
            return [len(data)]
        b = np.frombuffer(data, np.uint8)
        g = self.gear[b]
        h = np.zeros(len(b), np.uint64)
        for k in range(WINDOW):  # the hash of the WINDOW bytes up to each place, each shifted by its age
            h[k:] += g[: len(b) - k] << np.uint64(k)
        at = np.flatnonzero((h >> np.uint64(20) & np.uint64((1 << MASK_BITS) - 1)) == 0) + 1
        out, last = [], 0
        for p in at.tolist():
            if p - last >= LEAST and p < len(data) and data[p] & 0xC0 != 0x80:
                out.append(p)
                last = p
        return [*out, len(data)]

    def chunk(self, text: str, data: bytes) -> np.ndarray:
        key = hashlib.blake2b(data, digest_size=16).digest()
        ids = self.kept.get(key)
        if ids is not None:
            self.reused += 1
            return ids
        self.encoded += 1
        ids = self.raw(text)
        self.kept[key] = ids.astype(np.uint16) if len(self.lengths) <= 1 << 16 else ids
        self.kept_bytes += self.kept[key].nbytes + 200
        while self.kept_bytes > 24 << 20:
            old = next(iter(self.kept))
            self.kept_bytes -= self.kept.pop(old).nbytes + 200
        return ids

    def forget(self) -> None:
        self.kept.clear()
        self.kept_bytes = 0

    def stretch(self, text: str) -> np.ndarray:
        """ids of a stretch without special tokens."""
        data = text.encode()
        ends = self.cuts(data)
        if len(ends) == 1:
            return self.chunk(text, data)
        chunks, a = [], 0
        for b in ends:
            piece = data[a:b].decode()
            if chunks and (not EDGE.search(piece) or not EDGE.search(chunks[-1])):
                chunks[-1] += piece
            else:
                chunks.append(piece)
            a = b
        out = [self.chunk(chunks[0], chunks[0].encode())]
        for left, right in zip(chunks, chunks[1:], strict=False):
            ids = self.chunk(right, right.encode())
            if right[0] in BLANK and not left[-1].isspace():
                out.append(ids)  # the join is such an edge itself
                continue
            tail_at = self.last_edge(left)
            head_at = EDGE.search(right).end()
            tail, head = left[tail_at:], right[:head_at]
            out[-1] = self.without(out[-1], len(tail.encode()), end=True)
            out.append(self.raw(tail + head))
            out.append(self.without(ids, len(head.encode()), end=False))
        return np.concatenate(out)

    @staticmethod
    def last_edge(text: str) -> int:
        """The last place between a character that is no white space and one that is."""
        width = 64
        while True:
            part = text[-width:]
            at = [m.end() for m in EDGE.finditer(part)]
            if at:
                return len(text) - len(part) + at[-1]
            width *= 4

    def without(self, ids: np.ndarray, n_bytes: int, end: bool) -> np.ndarray:
        """ids less those of the first or last n_bytes, at whose edge a token must end."""
        part = ids[::-1] if end else ids
        width = 64
        while True:
            sums = np.cumsum(self.lengths[part[:width]])
            if len(sums) and sums[-1] >= n_bytes or width >= len(part):
                break
            width *= 4
        k = int(np.searchsorted(sums, n_bytes)) + 1 if n_bytes else 0
        if n_bytes and sums[k - 1] != n_bytes:
            raise AssertionError("encodings disagree at a pre-token edge")
        return ids[: len(ids) - k] if end else ids[k:]

    def encode(self, text: str) -> np.ndarray:
        if not self.split or not any(s in text for s in self.special):
            return self.stretch(text) if text else np.zeros(0, np.uint32)
        parts = [np.array([self.special[p]], np.uint32) if p in self.special else self.stretch(p) for p in self.split.split(text) if p]
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(documents: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (if kept), n_tokens, ids_sha256, decoded_sha256 of every whole text; null counts as empty.

    One pass over the rows, nothing shuffled. Rows with equal texts give equal results; repeated rows each give a row, an
    empty table none. Other columns of documents are not kept, so none can clash.
    """
    path = path or default_path()
    small_batches(documents.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, a, d, kept = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = np.ascontiguousarray(c.encode(text or ""), dtype="<u4")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        c.forget()  # the worker lives on

    kept = ", ids array<int>" if keep_ids else ""
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(rows, f"doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string{kept}")
