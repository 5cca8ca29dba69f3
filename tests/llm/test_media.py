"""Operator 4: exact round trips, the format's bits read one by one, and damage."""

import hashlib
import zlib

import numpy as np
import pytest

from tessella.llm import flac, media

RNG = np.random.default_rng(5)
TEXTS = [None, "", "a", "x" * 576, "x" * 577, "été " * 4000, "\x00\x7f" * 900, "".join(map(chr, RNG.integers(1, 0xD000, 3000))), "a" * 575 + "\n"]
BYTES = [media.padded((t or "").encode()) for t in TEXTS] + [RNG.bytes(576 * 5), b"\x00\xff" * 288 * 3, b"\x00" * 575 + b"\xff", (np.sin(np.arange(5760) / 9) * 120 + 128).astype(np.uint8).tobytes()]


def bits_of(frame):
    return "".join(f"{b:08b}" for b in frame)


def slow_decode(frame):
    """One frame read bit by bit, by the format's description."""
    b, at = bits_of(frame), 0

    def take(n):
        nonlocal at
        at += n
        return int(b[at - n : at] or "0", 2)

    def sign(x, n):
        return x - (1 << n) if n and x >> (n - 1) else x

    assert take(32) == 0xFFF82402
    first = take(8)
    for _ in range(max(0, f"{first:08b}".index("0") - 1) if first >= 0xC0 else 0):
        take(8)
    take(8)
    kind = take(8) >> 1
    if kind == 0:
        return [sign(take(8), 8)] * 576
    if kind == 1:
        return [sign(take(8), 8) for _ in range(576)]
    order = kind - 8 if kind < 32 else kind - 31
    out = [sign(take(8), 8) for _ in range(order)]
    shift, weights = 0, [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order] if kind < 32 else ()
    if kind >= 32:
        p = take(4) + 1
        shift = take(5)
        weights = [sign(take(p), p) for _ in range(order)]
    wide = 4 + take(2)
    parts = 1 << take(4)
    for part in range(parts):
        k = take(wide)
        raw = take(5) if k == (1 << wide) - 1 else None
        for _ in range(576 // parts - (order if part == 0 else 0)):
            if raw is not None:
                r = sign(take(raw), raw)
            else:
                q = 0
                while not take(1):
                    q += 1
                u = q << k | take(k)
                r = u >> 1 if u % 2 == 0 else -(u >> 1) - 1
            out.append(r + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
    return out


def test_round_trip_alone_and_together():
    streams = flac.encode(BYTES)
    assert flac.decode(streams) == BYTES
    assert [flac.encode([p])[0] for p in BYTES] == streams
    assert flac.encode([]) == flac.decode([]) == []


def test_frames_by_the_format():
    kinds = set()
    for payload, stream in zip(BYTES, flac.encode(BYTES), strict=True):
        _, _, first, offsets = flac.metadata(stream)
        ends = [*(first + offsets[1:]).tolist(), len(stream)]
        for k, (a, b) in enumerate(zip((first + offsets).tolist(), ends, strict=True)):
            want = (np.frombuffer(payload[576 * k : 576 * k + 576], np.uint8).astype(int) - 128).tolist()
            assert slow_decode(stream[a:b]) == want
            kinds.add(stream[a + 6] >> 1)
    assert {0, 1, 9, 35} <= kinds


def test_escaped_partitions_and_long_codes():
    x = np.zeros((1, 576), np.int64)
    x[0, 5:9] = [100, -128, 127, 3]
    # order 0, method 0, one partition, escaped with 8 bits; then the same with k = 0, whose codes are up to 255 zeros
    for rice in (False, True):
        body = "0" + "001000" + "0" + "00" + "0000" + ("0000" if rice else "1111" + "01000")
        for v in x[0].tolist():
            u = 2 * v if v >= 0 else -2 * v - 1
            body += "0" * u + "1" if rice else f"{v & 255:08b}"
        body += "0" * (-len(body) % 8)
        head = np.array([0xFF, 0xF8, 0x24, 0x02, 0], np.uint8)
        frame = np.concatenate([head, flac.crc8(head[:, None]), np.array([int(body[i : i + 8], 2) for i in range(0, len(body), 8)], np.uint8)])
        crc = int(flac.crc16(frame[:, None])[0])
        data = frame.tobytes() + bytes([crc >> 8, crc & 255])
        assert (flac.decode_frames(data, np.array([0]), np.array([len(data)]), np.array([0])) == x).all()


def test_known_checksums():
    column = np.frombuffer(b"123456789", np.uint8)[:, None]
    assert flac.crc8(column)[0] == 0xF4 and flac.crc16(column)[0] == 0xFEE8


def test_seek_and_scan():
    payload = BYTES[5]
    stream = flac.encode([payload])[0]
    for at, n in ((0, 1), (575, 2), (1000, 3000), (len(payload) - 1, 50), (len(payload), 5)):
        assert flac.seek(stream, at, n) == payload[at : at + n]
    at = 4 + 4 + 34
    table = int.from_bytes(stream[at + 1 : at + 4], "big")
    bare = stream[:4] + bytes([0x80]) + stream[5:at] + stream[at + 4 + table :]
    assert flac.decode([bare]) == [payload]


def test_damage_is_found():
    stream = flac.encode([BYTES[5]])[0]
    first = flac.metadata(stream)[2]
    for at in (0, 10, first, first + 2, first + 5, first + 40, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(flac.Damaged):
            flac.decode([bytes(bad)])


def test_query_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "n")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, media string, n_bytes int")
    stored = media.to_media(docs)
    got = {(r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.features(stored).collect()}
    assert got == {(i, len((t or "").encode()), len(p := media.padded((t or "").encode())), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for i, t in rows}
    blocks = {}
    for r in media.pcm_blocks(stored.where("id = 5").limit(1), samples=1152).collect():
        blocks[r.sample_offset] = bytes(r.pcm)
    assert b"".join(blocks[k] for k in sorted(blocks)) == media.padded(TEXTS[5].encode())
    assert media.features(media.to_media(docs.limit(0))).count() == 0
