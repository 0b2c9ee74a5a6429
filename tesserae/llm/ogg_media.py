"""Ogg media columns: write texts as Ogg tracks of 8-bit samples, and read Ogg bytes back.

The reader checks each page's checksum and sequence number, puts packets together again from
lacing values, demultiplexes logical streams by serial number, and derives each packet's time
from granule positions. One row is one physical stream, so all work is a narrow map: no shuffle,
and memory is bounded by one Arrow batch and one row's media.

Defined results: a null text counts as empty; an empty text is stored as 192 blanks; equal texts
give equal media and features (nothing depends on ids or order); further columns pass through
unless a result column has their name in any case, which then replaces them; an empty table gives no
rows; repeated rows stay repeated; nothing is ordered, so there are no ties; texts are taken whole,
and a very long one costs memory in proportion to its own length only. Media that break the format,
or whose last granule position isn't the length in the track's header, raise ValueError, naming the fault.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, map_batches, table

RATE = 8000
BLOCK = 192  #: samples dealt to the two tracks at a time: the first half to track 0, the rest to track 1
PACKET_SAMPLES = 3840  #: samples of a data packet
MAGIC = b"\x01smp8"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04c11db7, not reflected, from 0: zlib's CRC over bit-reversed bytes."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return whole[:22] + struct.pack("<I", page_checksum(whole)) + whole[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream. packets: bytes and the granule position at their end.

    The first packet, the stream's header, has a page to itself.
    """
    number = 0
    for header, group in ((True, packets[:1]), (False, packets[1:])):
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p, _ in group)
        body = b"".join(p for p, _ in group)
        ends = np.cumsum([len(p) // 255 + 1 for p, _ in group])
        at = taken = 0
        while at < len(lacing):
            part = lacing[at : at + 255]
            done = int(np.searchsorted(ends, at + len(part), "right"))
            finishes = done > int(np.searchsorted(ends, at, "right"))
            flags = (FIRST if header else 0) | (CONTINUED if at and lacing[at - 1] == 255 else 0)
            flags |= LAST if not header and at + len(part) == len(lacing) else 0
            size = sum(part)
            yield _page(flags, group[done - 1][1] if finishes else -1, serial, number, part, body[taken : taken + size])
            number, at, taken = number + 1, at + len(part), taken + size


def write_media(payload: bytes) -> bytes:
    """An Ogg physical stream of two interleaved tracks that holds payload without loss."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 2, BLOCK // 2)
    tracks = []
    for track in range(2):
        data = samples[:, track, :].tobytes()
        packets = [(MAGIC + struct.pack("<BIQ", track, RATE, len(data)), 0)]
        packets += [(data[i : i + PACKET_SAMPLES], min(i + PACKET_SAMPLES, len(data))) for i in range(0, len(data), PACKET_SAMPLES)]
        tracks.append(list(_pages(0x5E0 + track, packets)))
    longest = max(map(len, tracks))
    return b"".join(t[i] for i in range(longest) for t in tracks if i < len(t))


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """flags, granule, serial, number, lacing and body of each page, checksums verified."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, checksum, segments = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if version or len(lacing) < segments or end > len(media):
            raise ValueError(f"page at byte {at} is cut short or of another version")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise ValueError(f"page at byte {at} fails its checksum")
        yield flags, granule, serial, number, lacing, media[at + 27 + segments : end]
        at = end


def demultiplex(media: bytes) -> tuple[dict[int, list[tuple[bytes, int | None]]], int]:
    """Per serial number its packets, with the granule position where a page gives it; and the number of pages."""
    streams: dict[int, list] = {}
    open_: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    pages = 0
    for flags, granule, serial, number, lacing, body in read_pages(media):
        pages += 1
        if bool(flags & FIRST) != (serial not in streams) or serial in ended:
            raise ValueError(f"stream {serial} begins or ends twice, or not at all")
        packets, parts = streams.setdefault(serial, []), open_.setdefault(serial, [])
        if number != expected.get(serial, 0):
            raise ValueError(f"stream {serial} lacks page {expected.get(serial, 0)}")
        if bool(flags & CONTINUED) != bool(parts):
            raise ValueError(f"stream {serial}, page {number}: a packet is cut")
        expected[serial] = number + 1
        before, at, start = len(packets), 0, 0
        for value in lacing:
            at += value
            if value < 255:
                parts.append(body[start:at])
                packets.append((b"".join(parts), None))
                parts.clear()
                start = at
        if start < at or (lacing and lacing[-1] == 255):
            parts.append(body[start:at])
        if (len(packets) > before) != (granule != -1):
            raise ValueError(f"stream {serial}, page {number}: granule position {granule} without or beside a packet's end")
        if len(packets) > before:
            packets[-1] = (packets[-1][0], granule)
        if flags & LAST:
            ended.add(serial)
    if any(open_.values()) or ended != set(streams):
        raise ValueError("a stream has no end")
    return streams, pages


def packet_times(packets: list[tuple[bytes, int | None]]) -> list[tuple[int, int]]:
    """First and end sample of each data packet. A page's granule position dates the last packet
    that ends on it; those before it are dated backwards by their lengths."""
    times: list[tuple[int, int]] = [(0, 0)] * len(packets)
    end = None
    for i in range(len(packets) - 1, -1, -1):
        data, granule = packets[i]
        if granule is not None:
            if end is not None and granule != end:
                raise ValueError(f"granule position {granule} where {end} is due")
            end = granule
        if end is None:
            raise ValueError("the last packet has no granule position")
        times[i] = (end - len(data), end)
        end -= len(data)
    if packets and times[0][0] != 0:
        raise ValueError(f"the first packet starts at sample {times[0][0]}")
    return times


def read_media(media: bytes) -> tuple[bytes, str]:
    """The payload and a line of features, both from the stored bytes alone."""
    streams, pages = demultiplex(media)
    tracks: dict[int, np.ndarray] = {}
    count, seconds = 0, 0.0
    for packets in streams.values():
        header = packets[0][0]
        if header[: len(MAGIC)] != MAGIC:
            raise ValueError("unknown codec")
        track, rate, length = struct.unpack_from("<BIQ", header, len(MAGIC))
        times = packet_times(packets[1:])  # without gaps from sample 0 to the last granule position
        last = times[-1][1] if times else 0
        if last != length:
            raise ValueError(f"track {track} ends at sample {last}, where its header says {length}")
        if track in tracks:
            raise ValueError(f"track {track} occurs twice")
        tracks[track] = np.frombuffer(b"".join(data for data, _ in packets[1:]), np.uint8)
        count, seconds = count + len(packets), max(seconds, last / rate)
    if sorted(tracks) != [0, 1] or len(tracks[0]) != len(tracks[1]) or not len(tracks[0]) or len(tracks[0]) % (BLOCK // 2):
        raise ValueError("not two tracks of the same whole number of blocks")
    payload = np.stack([tracks[t].reshape(-1, BLOCK // 2) for t in sorted(tracks)], axis=1).tobytes()
    level = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    rms = float(np.sqrt(np.mean(np.square(level))))
    crossings = int(np.count_nonzero((level[1:] >= 0) != (level[:-1] >= 0)))
    return payload, (
        f"streams={len(streams)};pages={pages};packets={count};seconds={seconds:.6f};"
        f"mean={level.mean():.4f};rms={rms:.4f};peak={int(np.abs(level).max())};crossings={crossings}"
    )


def _added(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    own = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in own] + fields)


def write_ogg(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Add `media`, the Ogg bytes of the binary column `payload` (a positive multiple of 192 bytes)."""
    bounded_batches(df.sparkSession)
    schema = _added(df, [T.StructField(media, T.BinaryType())])
    passed, at = [df.columns.index(f.name) for f in schema.fields[:-1]], df.columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([write_media(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), made], names=schema.names)

    return map_batches(df, run, schema)


def read_ogg(df: DataFrame, media: str = "media") -> DataFrame:
    """Add `samples` (the payload read back) and `feature` from the binary column `media`."""
    bounded_batches(df.sparkSession)
    schema = _added(df, [T.StructField("samples", T.BinaryType()), T.StructField("feature", T.StringType())])
    passed, at = [df.columns.index(f.name) for f in schema.fields[:-2]], df.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_media(x) for x in batch.column(at).to_pylist()]
            made = [pa.array([x[0] for x in read], pa.binary()), pa.array([x[1] for x in read], pa.string())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), *made], names=schema.names)

    return map_batches(df, run, schema)


def padded(text: Column) -> Column:
    """UTF-8 bytes of text, with bytes 32 appended up to a positive multiple of 192."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    to = F.greatest(F.lit(1), F.ceil(size / F.lit(BLOCK))).cast("int") * BLOCK
    return F.encode(F.concat(F.coalesce(text, F.lit("")), F.repeat(F.lit(" "), to - size)), "UTF-8")


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), padded(F.col("text")).alias("payload")
    )
    stored = write_ogg(docs).drop("payload")
    return read_ogg(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
