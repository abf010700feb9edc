"""ISO media containers: write payloads as sample data, walk nested boxes, decode sample tables.

The reader stores codec, duration and keyframe byte ranges of each track without decoding payloads. Bytes that are no
container give status "malformed" and nulls; null bytes give status "empty". Payloads are only copied by byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import small_batches

UNIT = 64
RATE = 8000
SYNC_EVERY = 16
CHUNK_UNITS = 1024
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta"}
DEEPEST = 32


class Fragmented(Exception):
    pass


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """A one-track file of 8-bit mono samples, UNIT of them per access unit; len(payload) is a positive multiple of UNIT."""
    units = len(payload) // UNIT
    chunks = -(-units // CHUNK_UNITS)
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS, 1)] if chunks > 1 else []
    runs += [(chunks, last, 1)] if not runs or last != CHUNK_UNITS else []
    sync = np.arange(1, units + 1, SYNC_EVERY, dtype=">u4")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ")
    matrix = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    samples = units * UNIT
    times = lambda fmt, *v: struct.pack(fmt, *v)

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK_UNITS * UNIT)
        wide = first + len(payload) >= 1 << 32
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", times(">QQIQHH", 0, 0, RATE, samples, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
        tkhd = full(b"tkhd", times(">QQIIQ", 0, 0, 1, 0, samples), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", times(">QQIQ", 0, 0, RATE, samples), struct.pack(">IHH", 1 << 16, 256, 0), bytes(8), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    index = moov(len(ftyp) + len(moov(0)) + head)
    return ftyp + index + box(b"mdat", payload)


def walk(data: bytes, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, depth first; ValueError if a box leaves its parent or lies over DEEPEST deep."""
    stack: list[tuple[int, int, tuple[bytes, ...]]] = [(start, end, ())]
    while stack:
        start, end, path = stack.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("short box")
        n, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if n == 1:
            (n,), body = struct.unpack_from(">Q", data, body), body + 8
        elif n == 0:
            n = end - start
        if kind == b"uuid":
            body += 16
        if n < body - start or start + n > end:
            raise ValueError("box size")
        yield (*path, kind), body, start + n
        stack.append((start + n, end, path))
        if kind in NESTED:
            if len(path) >= DEEPEST:
                raise ValueError("boxes nested too deep")
            stack.append((body, start + n, (*path, kind)))


def numbers(data: bytes, box: tuple[int, int], kind: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    """The table behind a count in a full box; ValueError if the box does not hold as many entries as it says."""
    a, b = box
    (n,) = struct.unpack_from(">I", data, a + skip)
    if n * columns * np.dtype(kind).itemsize > b - a - skip - 4:
        raise ValueError("table longer than its box")
    out = np.frombuffer(data, kind, n * columns, a + skip + 4).astype(np.int64)
    return out.reshape(n, columns) if columns > 1 else out


def read_tracks(data: bytes) -> list[dict]:
    """codec, timescale, duration, sample offsets and sizes, and sync flags of each track.

    Counts are held against the lengths of their boxes and of the file before anything of their size is made.
    A file with fragments raises Fragmented: its samples are not in the tables.
    """
    tracks: list[dict] = []
    for path, a, b in walk(data, 0, len(data)):
        if path[-1] in (b"moof", b"mvex"):
            raise Fragmented("samples in fragments")
        if path[-1] == b"trak":
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and tracks:
            tracks[-1][path[-1]] = (a, b)
    out = []
    for t in tracks:
        a = t[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
        fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
        if fixed * n > len(data):
            raise ValueError("samples longer than the file")
        sizes = np.full(n, fixed, np.int64) if fixed else numbers(data, t[b"stsz"], ">u4", skip=8)
        chunk_at = numbers(data, t[b"co64"], ">u8") if b"co64" in t else numbers(data, t[b"stco"], ">u4")
        runs = numbers(data, t[b"stsc"], ">u4", 3)
        chunks = np.diff(np.append(runs[:, 0], len(chunk_at) + 1))
        if n and (not len(runs) or runs[0, 0] != 1 or (chunks < 0).any() or int((chunks * runs[:, 1]).sum()) != n):
            raise ValueError("chunks do not hold the samples")
        chunk = np.repeat(np.arange(len(chunk_at)), np.repeat(runs[:, 1], chunks)) if n else np.zeros(0, np.int64)
        before = np.cumsum(sizes) - sizes
        at = chunk_at[chunk] + before - before[np.searchsorted(chunk, chunk)]
        stts = numbers(data, t[b"stts"], ">u4", 2)
        sync = np.ones(n, bool)
        if b"stss" in t:
            keys = numbers(data, t[b"stss"], ">u4")
            if len(keys) and not 1 <= keys.min() <= keys.max() <= n:
                raise ValueError("keyframe outside the samples")
            sync[:] = False
            sync[keys - 1] = True
        if n and (at.min() < 0 or (at + sizes).max() > len(data)):
            raise ValueError("sample outside the file")
        out.append({"codec": codec, "timescale": scale, "duration": duration, "ticks": int((stts[:, 0] * stts[:, 1]).sum()), "at": at, "sizes": sizes, "sync": sync})
    return out


def sample_bytes(data: bytes, track: dict) -> bytes:
    """The samples in order; neighbouring byte ranges are copied at once."""
    at, sizes = track["at"], track["sizes"]
    if not len(at):
        return b""
    cut = np.flatnonzero(at[1:] != at[:-1] + sizes[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(at)) - 1
    return b"".join(data[a:b] for a, b in zip(at[first], at[last] + sizes[last], strict=True))


RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
TRACK = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", RANGES)])
RANGES_SQL = "array<struct<offset:bigint,length:bigint>>"


def keyframes(track: dict) -> list[dict]:
    return [{"offset": o, "length": n} for o, n in zip(track["at"][track["sync"]].tolist(), track["sizes"][track["sync"]].tolist(), strict=True)]


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """df's rows with status and tracks: codec, timescale, duration, n_samples and keyframes (byte ranges) of each track.

    status is "ok", "no track", "empty" (null or no bytes), "fragmented" (the samples are not in the tables) or
    "malformed"; tracks is null but for "ok". Columns of df with those names are replaced. An empty table gives no rows.
    """
    df = df.drop(*(c for c in df.columns if c.lower() in ("status", "tracks") and c != media))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status: list[str] = []
            tracks: list[list[dict] | None] = []
            for data in b.column(b.schema.get_field_index(media)).to_pylist():
                found = None
                try:
                    found = [{k: t[k] for k in ("codec", "timescale", "duration")} | {"n_samples": len(t["at"]), "keyframes": keyframes(t)} for t in read_tracks(data)] if data else None
                    status.append("empty" if not data else "ok" if found else "no track")
                except Fragmented:
                    status.append("fragmented")
                except (ValueError, KeyError, IndexError, OverflowError, struct.error):
                    status.append("malformed")
                tracks.append(found or None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(status, pa.string()), pa.array(tracks, pa.list_(TRACK))], names=[*b.schema.names, "status", "tracks"])

    kinds = f"status string, tracks array<struct<codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:{RANGES_SQL}>>"
    return df.mapInArrow(read, StructType([*df.schema.fields, *StructType.fromDDL(kinds).fields]))


def text_digests(documents: DataFrame) -> DataFrame:
    """Each text's payload written as a container, read back from it by its sample tables, and digested; codec, duration and keyframe ranges.

    A null text counts as empty; repeated rows each give a row, and an empty table none. One pass over the rows, nothing shuffled; memory holds
    one batch of texts and one container at a time.
    """

    small_batches(documents.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                media = write_container(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)))
                track = read_tracks(media)[0]
                back = sample_bytes(media, track)
                keys = keyframes(track)
                ends = "first={offset}+{length};".format(**keys[0]) + "last={offset}+{length}".format(**keys[-1])
                feature = f"codec={track['codec'].strip()};timescale={track['timescale']};duration={track['duration']};samples={len(track['at'])};keyframes={len(keys)};{ends}"
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, track["codec"], track["duration"], keys))
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), RANGES]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes"]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], names=names)

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        rows, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration bigint, "
        f"keyframes {RANGES_SQL}",
    )
