"""Media columns as ISO base media files (ISO/IEC 14496-12).

``to_media`` stores bytes as one track of 8-bit samples in packets of 576; ``probe`` walks the nested
boxes of such files, decodes the sample tables and gives codec, time scale, duration and the byte ranges
of the key packets, never touching the payload. ``payload`` reads the payload back by those tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamline.llm.texts import map_texts

PACKET = 576
RATE = 8_000
KEY_EVERY = 16
CHUNK = 8
CODEC = b"raw "
#: Boxes that hold boxes.
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 < 2**32:
        return struct.pack(">I4s", len(data) + 8, kind) + data
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data


def full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *body)


def padded(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the packet size."""
    return data + b"\xff" * (-len(data) % PACKET if data else PACKET)


def mux(payload: bytes) -> bytes:
    """A file whose track has the payload's packets as samples."""
    count = len(payload) // PACKET
    ticks = count * PACKET
    chunks = -(-count // CHUNK)
    rest = count - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if rest == CHUNK else [(1, rest, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, rest, 1)]
    keys = range(1, count + 1, KEY_EVERY)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(CODEC, bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        offsets = [first + k * CHUNK * PACKET for k in range(chunks)]
        wide = offsets[-1] >= 2**32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, count, PACKET)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", PACKET, count)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        information = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks & 0xFFFFFFFF, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), information)
        header = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks & 0xFFFFFFFF), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), MATRIX, bytes(8), flags=7)
        movie = full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, ticks & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 256), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", movie, box(b"trak", header, media))

    lead = 8 if len(payload) + 8 < 2**32 else 16
    start = len(head) + len(moov(0)) + lead
    made = moov(start)
    if len(made) + len(head) + lead != start:
        start = len(head) + len(made) + lead
        made = moov(start)
    return head + made + box(b"mdat", payload)


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    @property
    def key_ranges(self) -> list[tuple[int, int]]:
        return [(int(self.offsets[k]), int(self.sizes[k])) for k in self.keys]


def walk(data: memoryview, start: int, end: int):
    """kind, start and end of the body, for each box of a level."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        yield kind, at + head, at + size
        at += size


def tracks(data: memoryview) -> list[dict[bytes, tuple[int, int]]]:
    """The leaf boxes of each track by kind."""
    found: list[dict[bytes, tuple[int, int]]] = []
    pending = [(0, len(data), None)]
    while pending:
        start, end, track = pending.pop()
        for kind, a, b in walk(data, start, end):
            if kind == b"trak":
                found.append({})
                pending.append((a, b, found[-1]))
            elif kind in PARENTS:
                pending.append((a, b, track))
            elif track is not None:
                track.setdefault(kind, (a, b))
    return found


def table_of(data: memoryview, place: tuple[int, int], columns: int, kind: str = ">u4") -> np.ndarray:
    (count,) = struct.unpack_from(">I", data, place[0] + 4)
    return np.frombuffer(data, kind, count * columns, place[0] + 8).reshape(count, columns).astype(np.int64)


def decode(data: memoryview, leaf: dict[bytes, tuple[int, int]]) -> Track:
    version = data[leaf[b"mdhd"][0]]
    timescale = struct.unpack_from(">I", data, leaf[b"mdhd"][0] + (20 if version else 12))[0]
    codec = bytes(data[leaf[b"stsd"][0] + 12 : leaf[b"stsd"][0] + 16]).decode("latin-1")
    runs = table_of(data, leaf[b"stts"], 2)
    same, count = struct.unpack_from(">II", data, leaf[b"stsz"][0] + 4)
    if same * count > len(data):
        raise ValueError(f"{count} samples of {same} bytes do not fit")
    sizes = np.full(count, same, np.int64) if same else np.frombuffer(data, ">u4", count, leaf[b"stsz"][0] + 12).astype(np.int64)
    chunks = table_of(data, leaf[b"co64"], 1, ">u8")[:, 0] if b"co64" in leaf else table_of(data, leaf[b"stco"], 1)[:, 0]
    spread = table_of(data, leaf[b"stsc"], 3)
    first_chunk = spread[:, 0] - 1
    if count and (not len(spread) or first_chunk[0] or (np.diff(first_chunk) <= 0).any() or first_chunk[-1] >= len(chunks)):
        raise ValueError("runs of chunks are not in order")
    per_chunk = spread[np.searchsorted(first_chunk, np.arange(len(chunks)), "right") - 1, 1] if len(spread) else np.empty(0, np.int64)
    upto = np.cumsum(per_chunk)
    if count > (upto[-1] if len(upto) else 0):
        raise ValueError("chunks hold fewer samples than there are sizes")
    chunk = np.searchsorted(upto, np.arange(count), "right")
    before = np.cumsum(sizes) - sizes
    offsets = chunks[chunk] + before - before[(upto - per_chunk)[chunk]] if count else np.empty(0, np.int64)
    if count and ((offsets < 0).any() or (offsets + sizes > len(data)).any()):
        raise ValueError("samples lie outside the file")
    keys = table_of(data, leaf[b"stss"], 1)[:, 0] - 1 if b"stss" in leaf else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise ValueError("key samples that are none")
    return Track(codec, timescale, int((runs[:, 0] * runs[:, 1]).sum()), offsets, sizes, keys)


def payload(data: memoryview, track: Track) -> bytes:
    """The samples in order, by their byte ranges; adjacent ones are read at once."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cuts = [0, *(np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1).tolist(), len(ends)]
    return b"".join(bytes(data[track.offsets[a] : ends[b - 1]]) for a, b in zip(cuts, cuts[1:], strict=False))


def to_media(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_bytes`` of the text and ``media``, the file that stores it; null texts are empty ones."""
    return map_texts(df, text, "n_bytes bigint, media binary", lambda: lambda t: (len(t or b""), mux(padded(t or b""))), keep)


PROBED = "codec string, timescale bigint, duration bigint, samples bigint, keyframes array<struct<offset:bigint,length:bigint>>"
READ = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint"


def first_track(data: bytes | None) -> tuple[memoryview, Track]:
    view = memoryview(data or b"")
    found = tracks(view)
    if not found:
        raise ValueError("no track")
    return view, decode(view, found[0])


def probed(view: memoryview, t: Track) -> tuple:
    return t.codec, t.timescale, t.duration, len(t.sizes), [{"offset": o, "length": n} for o, n in t.key_ranges]


def digested(view: memoryview, t: Track) -> tuple:
    body = payload(view, t)
    return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])


def examine(df: DataFrame, media: str, keep: list[str], parts: list[tuple] | None = None) -> DataFrame:
    """``keep`` with what is asked of the first track of each file, and ``error``, in one reading.

    Null, empty or broken files have nulls and say why in ``error``; counts that a file claims are held
    against its size before anything is set aside for them.
    """
    asked = [(PROBED, probed), (READ, digested)] if parts is None else parts
    nulls = (None,) * sum(len(StructType.fromDDL(ddl)) for ddl, _ in asked)

    def of(data: bytes | None):
        try:
            view, track = first_track(data)
            return *[v for _, read in asked for v in read(view, track)], None
        except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
            return *nulls, f"{type(e).__name__}: {e}"

    return map_texts(df, media, ", ".join([*[ddl for ddl, _ in asked], "error string"]), lambda: of, keep)


def probe(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """``keep`` with codec, timescale, duration, samples, keyframes (offset, length) of the first track, error."""
    return examine(df, media, keep, [(PROBED, probed)])


def read_back(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """``keep`` with size, digest and tail checksum of the payload as the sample tables give it, error."""
    return examine(df, media, keep, [(READ, digested)])


def op6_iso_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as an ISO media file, probed and read back.

    ``feature``: codec, duration as ticks/ticks per second, and the key packets' offset+length.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = to_media(docs, "text", ["doc_id"])
    found = examine(stored, "media", ["doc_id", "n_bytes", "media"])
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["length"])), ",")
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", "codec", F.concat_ws("/", "duration", "timescale"), ranges).alias("feature"),
    )
