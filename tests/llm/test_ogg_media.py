import hashlib
import random
import struct
import zlib

import pytest

from tesserae.llm import ogg_media as o


def crc_by_bits(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(2)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert o.page_checksum(data) == crc_by_bits(data)


@pytest.mark.parametrize("blocks", [1, 2, 40, 41, 700, 5000])
def test_round_trip(blocks):
    payload = random.Random(blocks).randbytes(192 * blocks)
    media = o.write_media(payload)
    assert o.read_media(media)[0] == payload
    streams, _ = o.demultiplex(media)
    assert len(streams) == 2
    for packets in streams.values():
        times = o.packet_times(packets[1:])
        assert times[-1][1] == 96 * blocks and all(a[1] == b[0] for a, b in zip(times, times[1:]))


def test_packets_over_pages_and_multiples_of_255():
    packets = [(b"head", 0), (b"x" * 255, 255), (b"", 255), (b"y" * 70_000, 70_255), (b"z" * 510, 70_765)]
    media = b"".join(o._pages(7, packets))
    streams, pages = o.demultiplex(media)
    assert [p for p, _ in streams[7]] == [p for p, _ in packets] and pages == 3
    assert o.packet_times(streams[7][1:]) == [(0, 255), (255, 255), (255, 70_255), (70_255, 70_765)]


def test_faults_are_named():
    media = o.write_media(b"a" * 192 * 900)
    broken = media[:100] + bytes([media[100] ^ 1]) + media[101:]
    for bad, told in ((broken, "checksum"), (media[:-5], "cut short"), (b"x" + media, "no page")):
        with pytest.raises(ValueError, match=told):
            o.read_media(bad)
    pages, at = [], 0
    for *_, lacing, body in o.read_pages(media):
        size = 27 + len(lacing) + len(body)
        pages.append(media[at : at + size])
        at += size
    with pytest.raises(ValueError, match="lacks page"):
        o.read_media(b"".join(pages[:2] + pages[3:]))
    with pytest.raises(ValueError, match="no end"):
        o.read_media(b"".join(pages[:-1]))


def test_lengths_come_from_granules():
    """A stream that holds less or more than its header says, or of another codec, is an error, not memory."""
    body = bytes(range(96)) * 50
    head = lambda track, n, magic=o.MAGIC: magic + struct.pack("<BIQ", track, o.RATE, n)
    stream = lambda track, n, data, magic=o.MAGIC: b"".join(o._pages(track, [(head(track, n, magic), 0), (data, len(data))]))
    assert o.read_media(stream(0, 4800, body) + stream(1, 4800, body))[0]
    for bad, told in (
        (stream(0, 4800, body) + stream(1, 4800, body[:96]), "track 1 ends at sample 96, where its header says 4800"),
        (stream(0, 96, body) + stream(1, 96, body), "track 0 ends at sample 4800"),
        (stream(0, 4800, body, b"\x01xxxx") + stream(1, 4800, body), "unknown codec"),
        (stream(0, 4800, body), "two tracks"),
    ):
        with pytest.raises(ValueError, match=told):
            o.read_media(bad)


def plain_feature(media):
    """The feature line by loops over bytes: pages are cut by their own headers, tracks by serial numbers."""
    at, pages, packets, tracks = 0, 0, {}, {}
    while at < len(media):
        flags, granule, serial = media[at + 5], int.from_bytes(media[at + 6 : at + 14], "little", signed=True), media[at + 14 : at + 18]
        lacing = list(media[at + 27 : at + 27 + media[at + 26]])
        start = at + 27 + len(lacing)
        body = media[start : start + sum(lacing)]
        packets[serial] = packets.get(serial, 0) + sum(v < 255 for v in lacing)
        tracks.setdefault(serial, [b"", 0])
        if not flags & 2:
            tracks[serial] = [tracks[serial][0] + body, granule]
        at, pages = start + len(body), pages + 1
    a, b = (tracks[s][0] for s in sorted(tracks, key=lambda s: s[::-1]))
    payload = b"".join(a[i : i + 96] + b[i : i + 96] for i in range(0, len(a), 96))
    level = [x - 128 for x in payload]
    crossings = sum((x >= 0) != (y >= 0) for x, y in zip(level, level[1:]))
    seconds = max(g for _, g in tracks.values()) / 8000
    return payload, (
        f"streams={len(tracks)};pages={pages};packets={sum(packets.values())};seconds={seconds:.6f};mean={sum(level) / len(level):.4f};"
        f"rms={(sum(x * x for x in level) / len(level)) ** 0.5:.4f};peak={max(map(abs, level))};crossings={crossings}"
    )


@pytest.mark.parametrize("blocks", [1, 3, 90, 1500])
def test_features_by_loops(blocks):
    payload = random.Random(blocks).randbytes(192 * blocks)
    media = o.write_media(payload)
    assert plain_feature(media) == (payload, o.read_media(media)[1])


def test_query(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 100), (5, "é" * 100), (None, "long " * 50_000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in o.op1_ogg_media(spark, str(tmp_path)).collect()}
    for i, x in texts:
        raw = (x or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = o.write_media(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature == plain_feature(media)[1]
    assert rows[1][1:] == rows[2][1:] and rows[4][1:] == rows[5][1:]
