"""Media columns as ISO base media files: a writer for 8-bit sample tracks and a reader of boxes and sample tables.

The payload becomes an audio track of raw 8-bit samples, ``FRAME`` bytes a frame, ``CHUNK`` frames a chunk, and the
first frame of each chunk a sync sample. The reader walks the nested boxes and decodes the sample tables; codec,
duration and the byte ranges of key frames come from these tables, never from the payload.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

FRAME, CHUNK, RATE = 192, 64, 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"}
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "codec string, duration_s double, keyframes array<struct<offset:long,size:long>>"
)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes) -> bytes:
    """Blanks up to a positive multiple of FRAME."""
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


def write_media(payload: bytes) -> bytes:
    """The payload as an ISO media file; its length must be a positive multiple of FRAME."""
    import numpy as np

    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    rest = frames - (chunks - 1) * CHUNK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, rest, 1)] * (rest != CHUNK or chunks == 1)
    entry = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = (first + np.arange(chunks, dtype=np.uint64) * (FRAME * CHUNK)).astype(">u8" if wide else ">u4").tobytes()
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks) * CHUNK).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets),
        )
        minf = box(b"minf", full(b"smhd", b"\0" * 4), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)), full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, b"\0" * 8, flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, len(payload), 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    index = moov(len(head) + len(moov(0)) + 8)
    return b"".join((head, index, struct.pack(">I4s", 8 + len(payload), b"mdat"), payload))


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of each box's body, parents first; 64-bit sizes and size 0 (to the end) are understood."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        size = size or end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} of {size} bytes doesn't fit")
        yield (*path, kind), body, at + size
        if kind in CONTAINERS:
            yield from walk(data, body, at + size, (*path, kind))
        at += size


def read_tracks(data: bytes) -> list[dict]:
    """Of each track its codec, duration, sample sizes and offsets, and key frames, from its own tables alone.

    Sample sizes may be equal, listed, or compact (4, 8 or 16 bits). Fragments keep their tables elsewhere: a file with
    any is an error, as is a track without a table that it needs.
    """
    import numpy as np

    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in walk(data):
        if path[-1] == b"moof":
            raise ValueError("fragmented files aren't read")
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], (start, end))
    return [_read_track(data, found, np) for found in tracks]


def _read_track(data: bytes, found: dict[bytes, tuple[int, int]], np) -> dict:
    for kind in (b"mdhd", b"stsd", b"stsc", b"stts"):
        if kind not in found:
            raise ValueError(f"a track has no {kind.decode()}")
    if not {b"stsz", b"stz2"} & found.keys() or not {b"stco", b"co64"} & found.keys():
        raise ValueError("a track has no sample sizes or no chunk offsets")

    def numbers(kind: bytes, skip: int, count: int, width: str = ">u4"):
        start, end = found[kind]
        if start + skip + count * int(width[2:]) > end:
            raise ValueError(f"table {kind.decode()} is cut short")
        return np.frombuffer(data, width, count, start + skip)

    def sample_sizes():
        if b"stsz" in found:
            size, count = (int(x) for x in numbers(b"stsz", 4, 2))
            return np.full(count, size, np.int64) if size else numbers(b"stsz", 12, count).astype(np.int64)
        bits, count = int(numbers(b"stz2", 4, 1)[0]) & 0xFF, int(numbers(b"stz2", 8, 1)[0])
        if bits == 4:
            pairs = numbers(b"stz2", 12, -(-count // 2), ">u1")
            return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:count].astype(np.int64)
        return numbers(b"stz2", 12, count, {8: ">u1", 16: ">u2"}[bits]).astype(np.int64)

    version = data[found[b"mdhd"][0]]
    scale, duration = struct.unpack_from(">IQ" if version else ">II", data, found[b"mdhd"][0] + (20 if version else 12))
    codec = struct.unpack_from(">4s", data, found[b"stsd"][0] + 12)[0].decode("latin-1")
    sizes = sample_sizes()
    count = len(sizes)
    kind, width = (b"co64", ">u8") if b"co64" in found else (b"stco", ">u4")
    chunks = int(numbers(kind, 4, 1)[0])
    offsets = numbers(kind, 8, chunks, width).astype(np.int64)
    runs = numbers(b"stsc", 8, 3 * int(numbers(b"stsc", 4, 1)[0])).reshape(-1, 3).astype(np.int64)
    until = np.append(runs[1:, 0], chunks + 1)
    chunk_of = np.repeat(np.arange(chunks), np.repeat(runs[:, 1], until - runs[:, 0]))[:count]
    if len(chunk_of) < count:
        raise ValueError("samples without a chunk")
    before = np.cumsum(sizes) - sizes
    firsts = np.searchsorted(chunk_of, np.arange(chunks))
    held = firsts < np.searchsorted(chunk_of, np.arange(chunks), side="right")
    at = offsets[chunk_of] + before - before[firsts[held]][np.cumsum(held)[chunk_of] - 1] if count else np.zeros(0, np.int64)
    steps = numbers(b"stts", 8, 2 * int(numbers(b"stts", 4, 1)[0])).reshape(-1, 2).astype(np.int64)
    keys = numbers(b"stss", 8, int(numbers(b"stss", 4, 1)[0])).astype(np.int64) - 1 if b"stss" in found else np.arange(count)
    ends = np.searchsorted(chunk_of, np.arange(chunks), side="right") - 1
    return {
        "codec": codec, "timescale": scale, "duration": duration, "ticks": int((steps[:, 0] * steps[:, 1]).sum()), "samples": int(count), "keys": np.stack([at[keys], sizes[keys]], 1),
        "extents": [(int(at[a]), int(at[b] + sizes[b])) for a, b in zip(firsts[held], ends[held], strict=True)],
    }


def read_media(data: bytes) -> dict:
    """The first track, see read_tracks()."""
    tracks = read_tracks(data)
    if not tracks:
        raise ValueError("no track")
    return tracks[0]


def encode_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, null as empty, stored losslessly. Equal texts give equal files."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 500):
            raw = utf8(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([write_media(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """One row per media value of (doc_id, n_bytes, media): what its tables say, and digests of the bytes read back."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))]
        for batch in slices(batches, 500):
            rows = []
            for data in batch.column(2).to_pylist():
                got = read_media(data)
                payload = b"".join(data[a:b] for a, b in got["extents"])
                keys = got["keys"].tolist()
                feature = json.dumps({"codec": got["codec"], "timescale": got["timescale"], "duration": got["duration"], "samples": got["samples"], "keyframes": len(keys), "keyframe_crc32": zlib.crc32(got["keys"].astype("<i8").tobytes())})
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, got["codec"], got["duration"] / got["timescale"], [{"offset": a, "size": b} for a, b in keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, SCHEMA)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a media file, and what the file's boxes say."""
    return describe_media(encode_media(table(spark, sf_dir, "documents")))


def media_payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_media_columns that SQL can say."""
    return op6_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES = {"op6_media_columns": op6_media_columns, "media_payload_columns": media_payload_columns}
ORACLES: dict[str, str] = {
    "media_payload_columns": """SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(t || repeat(' ', p - n)) AS payload_sha256 FROM (SELECT doc_id, t, n, 192 * greatest(1, (n + 191) // 192) AS p FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents))"""
}
