"""ISO media containers: nested boxes, sample tables, codec, duration and keyframe byte ranges.

``media_columns`` reads containers held in a binary column. It walks the boxes by their sizes, decodes
the sample tables of every track (stsd, stts, stss, stsc, stsz or stz2, stco or co64) and lists where the
samples lie; it never decodes a payload. ``pack_text`` stores texts as such containers: one track of
uncompressed 8-bit samples, 64 to an access unit, each ``KEY_EVERY``-th unit a sync sample.

Defined results: a null text is stored as an empty one; a null container gives nulls and error "null";
a damaged one gives what could be read and the reason in ``error``; an empty table gives an empty
result. Repeated rows and ids are independent rows. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.llm.common import pieces, whole_text

UNIT, RATE, UNITS_PER_CHUNK, KEY_EVERY = 64, 8_000, 64, 16
#: Boxes that hold boxes, and the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0,
              b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"dref": 8}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(kind: bytes, rows: np.ndarray) -> bytes:
    return full_box(kind, 0, struct.pack(">I", len(rows)), rows.astype(">u4").tobytes())


def pack_payload(payload: bytes) -> bytes:
    """A container whose only track holds the payload as access units of 64 8-bit samples."""
    units = len(payload) // UNIT
    chunks = -(-units // UNITS_PER_CHUNK)
    last = units - (chunks - 1) * UNITS_PER_CHUNK
    runs = [(1, UNITS_PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    duration = units * UNIT

    def moov(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.int64) * UNITS_PER_CHUNK * UNIT
        wide = at + len(payload) >= 1 << 32
        places = (full_box(b"co64", 0, struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide
                  else _table(b"stco", offsets))
        tables = box(
            b"stbl", full_box(b"stsd", 0, struct.pack(">I", 1), entry), _table(b"stts", np.array([(units, UNIT)])),
            _table(b"stss", np.arange(1, units + 1, KEY_EVERY)), _table(b"stsc", np.array(runs)),
            full_box(b"stsz", 0, struct.pack(">II", UNIT, units)), places)
        media = box(
            b"mdia", full_box(b"mdhd", 0, struct.pack(">4IHH", 0, 0, RATE, duration, 0x55C4, 0)),
            full_box(b"hdlr", 0, bytes(4), b"soun", bytes(13)),
            box(b"minf", full_box(b"smhd", 0, bytes(4)),
                box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1))), tables))
        head = full_box(b"tkhd", 7, struct.pack(">5I", 0, 0, 1, 0, duration), bytes(8), struct.pack(">4H", 0, 0, 0x100, 0), matrix, bytes(8))
        return box(b"moov", full_box(b"mvhd", 0, struct.pack(">4IIH", 0, 0, RATE, duration, 0x10000, 0x100), bytes(10), matrix,
                                     bytes(24), struct.pack(">I", 2)), box(b"trak", head, media))

    kind = box(b"ftyp", b"qt  ", bytes(4), b"qt  ")
    start = len(kind) + len(moov(0)) + 8
    return kind + moov(start) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str | None = None
    timescale: int = 0
    duration: int = 0
    boxes: dict = field(default_factory=dict)

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets and sizes of all samples, and the indices of the sync samples."""
        b = self.boxes
        if b"stsz" in b:
            same, count = struct.unpack_from(">II", b[b"stsz"], 4)
            size = np.full(count, same, np.int64) if same else np.frombuffer(b[b"stsz"], ">u4", count, 12).astype(np.int64)
        elif b"stz2" in b:
            bits, count = b[b"stz2"][7], struct.unpack_from(">I", b[b"stz2"], 8)[0]
            if bits == 4:
                raw = np.frombuffer(b[b"stz2"], np.uint8, -(-count // 2), 12)
                size = np.stack([raw >> 4, raw & 15], 1).ravel()[:count].astype(np.int64)
            else:
                size = np.frombuffer(b[b"stz2"], {8: "u1", 16: ">u2"}[bits], count, 12).astype(np.int64)
        else:
            return (np.zeros(0, np.int64),) * 3
        places = np.frombuffer(b[b"co64"], ">u8", -1, 8) if b"co64" in b else np.frombuffer(b[b"stco"], ">u4", -1, 8)
        places = places.astype(np.int64)
        runs = np.frombuffer(b[b"stsc"], ">u4", -1, 8).reshape(-1, 3).astype(np.int64)
        until = np.append(runs[1:, 0], len(places) + 1)
        per_chunk = np.repeat(runs[:, 1], np.maximum(until - runs[:, 0], 0))
        if per_chunk.sum() != len(size) or len(per_chunk) != len(places):
            raise ValueError("sample tables disagree")
        chunk = np.repeat(np.arange(len(places)), per_chunk)
        before = np.cumsum(size) - size
        first = np.cumsum(per_chunk) - per_chunk
        base = before[np.minimum(first, max(len(size) - 1, 0))] if len(size) else first
        offset = places[chunk] + before - base[chunk]
        if b"stss" in b:
            key = np.frombuffer(b[b"stss"], ">u4", -1, 8).astype(np.int64) - 1
        else:
            key = np.arange(len(size))  # without the table every sample is one
        if len(key) and (key.min() < 0 or key.max() >= len(size)):
            raise ValueError("sync sample out of range")
        return offset, size, key


def walk(data: memoryview, start: int, stop: int, found) -> None:
    """Call found(kind, content start, content stop, depth path) for each box between start and stop."""
    stack = [(start, stop, ())]
    while stack:
        at, end, path = stack.pop()
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                raise ValueError(f"box {kind!r} at {at} reaches beyond its parent")
            found(kind, at + head, at + size, path)
            if kind in CONTAINERS and path[-1:] != (b"stsd",):
                stack.append((at + head + CONTAINERS[kind], at + size, (*path, kind)))
            at += size


def read_tracks(data: bytes) -> list[Track]:
    """The tracks of a container; payload boxes are passed over unread."""
    view, tracks, spans = memoryview(data), [], []

    def found(kind, start, stop, path):
        if kind == b"trak":
            tracks.append(Track())
            spans.append((start, stop))
            return
        of = next((t for t, (a, b) in zip(tracks, spans) if a <= start and stop <= b), None)
        if of is None:
            return
        if path[-1:] == (b"stsd",) and of.codec is None:
            of.codec = kind.decode("latin-1").strip()
        elif kind == b"mdhd":
            long = view[start] == 1
            of.timescale, of.duration = struct.unpack_from(">IQ" if long else ">II", view, start + (20 if long else 12))
        elif path[-1:] == (b"stbl",):
            of.boxes[kind] = view[start:stop]

    walk(view, 0, len(view), found)
    return tracks


KEYFRAME = pa.struct([("track", pa.int32()), ("sample", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])
FIELDS = [("codec", pa.string(), "string"), ("duration_s", pa.float64(), "double"), ("n_tracks", pa.int32(), "int"),
          ("n_samples", pa.int64(), "bigint"), ("sample_bytes", pa.int64(), "bigint"),
          ("keyframes", pa.list_(KEYFRAME), "array<struct<track:int,sample:bigint,offset:bigint,size:bigint>>"),
          ("error", pa.string(), "string")]


def describe(data: bytes | None) -> tuple[dict, list[tuple[np.ndarray, np.ndarray]]]:
    """Column values of a container, and the offsets and sizes of each track's samples."""
    row = dict.fromkeys((f[0] for f in FIELDS))
    if data is None:
        return row | {"error": "null"}, []
    spans, keys = [], []
    try:
        tracks = read_tracks(data)
        row |= {"codec": tracks[0].codec if tracks else None, "n_tracks": len(tracks), "duration_s": max(
            (t.duration / t.timescale for t in tracks if t.timescale), default=None)}
        for n, t in enumerate(tracks):
            offset, size, key = t.samples()
            if len(offset) and (offset + size).max() > len(data):
                raise ValueError("sample beyond the end")
            spans.append((offset, size))
            keys += [{"track": n, "sample": int(k), "offset": int(offset[k]), "size": int(size[k])} for k in key]
    except (ValueError, KeyError, IndexError, struct.error) as e:
        row["error"] = str(e) or type(e).__name__
    return row | {"n_samples": sum(len(o) for o, _ in spans), "sample_bytes": int(sum(s.sum() for _, s in spans)), "keyframes": keys}, spans


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with codec, duration_s, n_tracks, n_samples, sample_bytes, keyframes and error of a container column.

    ``df`` must have no columns of these names.
    """
    def work(batches):
        for batch in pieces(batches, media):
            rows = [describe(x.as_py())[0] for x in batch[media]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([r[n] for r in rows], t) for n, t, _ in FIELDS]],
                names=[*batch.schema.names, *[f[0] for f in FIELDS]])

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, _, t in FIELDS)).fields])
    return df.mapInArrow(work, schema)


def padded(data: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def pack_text(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with its text column replaced by n_bytes and the container ``media`` of the whole text."""
    rest = [c for c in df.columns if c != text]

    def work(batches):
        for batch in pieces(batches, text):
            raw = [x.as_py().encode() for x in batch[text]]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in rest], pa.array(map(len, raw), pa.int64()), pa.array([pack_payload(padded(x)) for x in raw], pa.binary())],
                names=[*rest, "n_bytes", media])

    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])
    return df.select(*rest, whole_text(text).alias(text)).mapInArrow(work, schema)


def stored_payloads(df: DataFrame, media: str = "media") -> DataFrame:
    """(doc_id, n_bytes, payload digests, feature): payloads read back from containers by their sample tables."""
    def work(batches):
        for batch in pieces(batches, media):
            out = []
            for data in batch[media]:
                data = data.as_py()
                row, spans = describe(data)
                if row["error"]:
                    raise ValueError(f"stored container is damaged: {row['error']}")
                view = memoryview(data)
                payload = b"".join(view[o:o + n] for o, n in zip(*(x.tolist() for x in _joined(*spans[0]))))
                keys = row["keyframes"]
                ranges = np.array([(k["offset"], k["size"]) for k in keys], "<i8").tobytes()
                feature = (f"codec={row['codec']};duration={row['duration_s']:.6f};tracks={row['n_tracks']};samples={row['n_samples']};"
                           f"keyframes={len(keys)};first_key={keys[0]['offset']}+{keys[0]['size']};"
                           f"last_key={keys[-1]['offset']}+{keys[-1]['size']};key_ranges_crc32={zlib.crc32(ranges)}")
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data),
                            hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*out))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = T.StructType([df.schema["doc_id"], *T.StructType.fromDDL(
        "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, feature string").fields])
    return df.select("doc_id", "n_bytes", F.col(media)).mapInArrow(work, schema)


def _joined(offset: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges with neighbours that touch made one."""
    starts = np.flatnonzero(np.append(True, offset[1:] != offset[:-1] + size[:-1]))
    return offset[starts], np.add.reduceat(size, starts)
