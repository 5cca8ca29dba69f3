"""FLAC streams of 8-bit mono samples, encoded and decoded for many frames at once (part of operator 4).

All frames of a batch stand side by side in arrays, and each step of the bit stream is taken for every frame together:
Rice codes are read with one 64-bit window per frame, predictors are undone sample by sample across frames.
Streams have a STREAMINFO block and a SEEKTABLE with a point for each frame. The decoder reads constant, verbatim, fixed
and LPC subframes with Rice parameters of 4 or 5 bits, checks the CRC-8 of each frame header, the CRC-16 of each frame,
and the MD5 of the samples.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np

#: Samples of a frame; Rice partitions are 2**PARTITIONS; predictors of up to ORDER samples; LPC precision and shift.
BLOCK, PARTITIONS, ORDER, PRECISION, SHIFT, RATE = 576, 3, 4, 9, 6, 8000
#: Coefficients of the format's fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
CONSTANT, VERBATIM = 0, 1


class Damaged(ValueError):
    """A stream whose checksums or fields don't hold."""


@functools.cache
def crc_table(width: int, poly: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint8 if width == 8 else np.uint16)


def right_aligned(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Column j of all spans together, the last one their last bytes; zeros before, which leave a CRC from 0 as it is."""
    most = int((stops - starts).max(initial=0))
    at = stops[None, :] - most + np.arange(most)[:, None]
    return np.where(at >= starts[None, :], data[np.maximum(at, 0)], 0).astype(np.uint8)


def crc8(columns: np.ndarray) -> np.ndarray:
    table, crc = crc_table(8, 0x07), np.zeros(columns.shape[1], np.uint8)
    for column in columns:
        crc = table[crc ^ column]
    return crc


def crc16(columns: np.ndarray) -> np.ndarray:
    table, crc = crc_table(16, 0x8005), np.zeros(columns.shape[1], np.uint16)
    for column in columns:
        crc = table[(crc >> np.uint16(8)) ^ column] ^ (crc << np.uint16(8))
    return crc


def number_bytes(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The format's coded frame numbers: bytes (frames x 6) and how many count."""
    out, count = np.zeros((len(number), 6), np.int64), np.ones(len(number), np.int64)
    out[:, 0] = number
    for n, limit in ((2, 1 << 7), (3, 1 << 11), (4, 1 << 16), (5, 1 << 21), (6, 1 << 26)):
        longer = number >= limit
        if not longer.any():
            break
        count[longer] = n
        x = number[longer]
        out[longer, 0] = ((0xFF00 >> n) & 0xFF) | x >> 6 * (n - 1)
        for k in range(1, n):
            out[longer, k] = 0x80 | (x >> 6 * (n - 1 - k)) & 0x3F
    return out, count


def lpc(samples: np.ndarray) -> np.ndarray:
    """Quantised coefficients (frames x ORDER) by autocorrelation and the Levinson recursion."""
    x = samples.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", x[:, k:], x[:, : x.shape[1] - k]) for k in range(ORDER + 1)], 1)
    a, error = np.zeros((len(x), ORDER)), np.where(r[:, 0] > 0, r[:, 0] * (1 + 1e-9), 1.0)
    for i in range(ORDER):
        k = (r[:, i + 1] - sum((a[:, j] * r[:, i - j] for j in range(i)), np.zeros(len(x)))) / error
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    top = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -top, top - 1).astype(np.int64)


def residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (frames x BLOCK, warm-up samples in place), kind (0 to ORDER fixed, ORDER + 1 LPC) and LPC coefficients."""
    coefficients = lpc(x)
    best, kind = x.copy(), np.zeros(len(x), np.int64)
    cost = np.abs(x).sum(1)
    d = x
    for p in range(1, ORDER + 2):
        if p <= ORDER:
            d = np.diff(d, axis=1)
            r = d
        else:
            p, predicted = ORDER, np.zeros((len(x), BLOCK - ORDER), np.int32)
            for j in range(ORDER):
                predicted += coefficients[:, j, None].astype(np.int32) * x[:, ORDER - 1 - j : BLOCK - 1 - j]
            r = x[:, ORDER:] - (predicted >> SHIFT)
        c = np.abs(r).sum(1)
        better = c < cost
        best[better, :p], best[better, p:], cost[better] = x[better, :p], r[better], c[better]
        kind[better] = p if r is d else ORDER + 1
    return best, kind, coefficients


def frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of samples x (frames x BLOCK) one after another, and where each begins (one more at the end)."""
    n = len(x)
    res, kind, coefficients = residuals(x)
    order = np.minimum(kind, ORDER)
    parts, width = 1 << PARTITIONS, BLOCK >> PARTITIONS
    u = np.where(res >= 0, 2 * res, -2 * res - 1)
    warm = np.arange(BLOCK)[None, :] < order[:, None]
    u[warm] = 0
    u = u.reshape(n, parts, width)
    total, most = u.sum(2), u.max(2)
    ks = np.arange(15)
    guess = width * (ks + 1) + (total[..., None] >> ks)
    guess[(most[..., None] >> ks) > 30] = 1 << 40  # unary parts stay short
    k = guess.argmin(2)
    bits = (u >> k[..., None]) + 1 + k[..., None]
    bits.reshape(n, BLOCK)[warm] = 0
    head, head_n = np.zeros((n, 17), np.int64), np.zeros((n, 17), np.int64)
    coded, count = number_bytes(number)
    raw = np.concatenate([np.tile(np.array([0xFF, 0xF8, 0x24, 0x02]), (n, 1)), coded], 1)
    lengths = 4 + count
    flat = np.zeros((n, 10), np.uint8)
    flat[:] = raw
    crc = crc8(right_aligned(flat.ravel(), np.arange(n) * 10, np.arange(n) * 10 + lengths))
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (bits.sum((1, 2)) + 4 * parts + 8 * order > 8 * BLOCK)
    plain = constant | verbatim
    kinds = np.where(constant, CONSTANT, np.where(verbatim, VERBATIM, np.where(kind <= ORDER, 8 + kind, 32 + ORDER - 1)))
    head[:, :10], head_n[:, :10] = raw, 8 * (np.arange(10)[None, :] < lengths[:, None])
    head[:, 10], head_n[:, 10] = crc, 8
    head[:, 11], head_n[:, 11] = kinds << 1, 8
    for j in range(ORDER):
        head[:, 12 + j] = x[:, j] & 0xFF
        head_n[:, 12 + j] = 8 * np.where(constant, j == 0, ~verbatim & (j < order))
    is_lpc = ~plain & (kind > ORDER)
    packed = np.full(n, (PRECISION - 1) << 5 | SHIFT, np.int64)
    for j in range(ORDER):
        packed = packed << PRECISION | coefficients[:, j] & ((1 << PRECISION) - 1)
    head[:, 16], head_n[:, 16] = np.where(is_lpc, packed, 0), np.where(is_lpc, 9 + ORDER * PRECISION, 0)
    value = np.empty((n, parts, width + 1), np.int64)
    size = np.empty((n, parts, width + 1), np.int64)
    value[:, :, 0], size[:, :, 0] = k, 4
    value[:, :, 1:] = (1 << k)[..., None] | u & ((1 << k) - 1)[..., None]
    size[:, :, 1:] = bits
    skip = warm.reshape(n, parts, width)
    value[:, :, 1:][skip] = 0
    if plain.any():
        size[plain] = 0
        v = np.flatnonzero(verbatim)
        value[v, :, 1:], size[v, :, 1:] = (x[v] & 0xFF).reshape(len(v), parts, width), 8
        value[constant] = 0
        value[v, :, 0] = 0
    method, method_n = np.full((n, 1), PARTITIONS, np.int64), np.where(plain, 0, 6)[:, None]
    body, body_n = value.reshape(n, -1), size.reshape(n, -1)
    used = head_n.sum(1) + method_n[:, 0] + body_n.sum(1)
    pad = -used % 8
    values = np.concatenate([head, np.where(method_n > 0, method, 0), body, np.zeros((n, 1), np.int64)], 1)
    sizes = np.concatenate([head_n, method_n, body_n, (pad + 16)[:, None]], 1)
    begins = np.concatenate([[0], np.cumsum((used + pad + 16) // 8)])
    data = pack(values.ravel().astype(np.uint64), sizes.ravel())
    check = crc16(right_aligned(data, begins[:-1], begins[1:] - 2))
    data[begins[1:] - 2], data[begins[1:] - 1] = check >> 8, check & 0xFF
    return data[: begins[-1]], begins


def pack(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of the values, each in its number of bits (under 64), most significant first."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    word, end = start >> 6, (start & 63) + sizes
    over = np.flatnonzero(end > 64)
    left = np.maximum(64 - end, 0).astype(np.uint64)
    here = values << left
    here[end <= (start & 63)] = 0
    here[over] = values[over] >> (end[over] - 64).astype(np.uint64)
    words = np.zeros(int(stop[-1] >> 6) + 2 if len(stop) else 0, np.uint64)
    if len(stop):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.add.reduceat(here, first)
        words[word[over] + 1] += values[over] << (128 - end[over]).astype(np.uint64)
    return np.frombuffer(words.astype(">u8").tobytes(), np.uint8).copy()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose lengths are positive multiples of BLOCK."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.arange(len(raw)) - np.repeat(np.cumsum(counts) - counts, counts)
    data, begins = [], [np.zeros(1, np.int64)]
    for i in range(0, len(raw), 2048):
        part, at = frames(raw[i : i + 2048].astype(np.int32) - 128, numbers[i : i + 2048])
        data.append(part.tobytes())
        begins.append(at[1:] + begins[-1][-1])
    body, at = b"".join(data), np.concatenate(begins)
    out, first = [], 0
    for payload, n in zip(payloads, counts.tolist(), strict=True):
        spans = at[first : first + n + 1]
        sizes = np.diff(spans)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        points["sample"], points["offset"], points["samples"] = np.arange(n) * BLOCK, spans[:-1] - spans[0], BLOCK
        blocks, step = [], 900_000
        for k in range(0, n, step):
            table = points[k : k + step].tobytes()
            blocks.append(bytes([3]) + len(table).to_bytes(3, "big") + table)
        blocks[-1] = bytes([0x83]) + blocks[-1][1:]
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + b"".join(blocks) + body[spans[0] : spans[-1]])
        first += n
    return out


class Window:
    """Bits of a buffer at one place per frame."""

    def __init__(self, data: bytes):
        self.words = np.frombuffer(data + b"\0" * (-len(data) % 8 + 16), ">u8").astype(np.uint64)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        i, s = at >> 6, (at & 63).astype(np.uint64)
        return self.words[i] << s | (self.words[i + 1] >> np.uint64(1)) >> (np.uint64(63) - s)

    def take(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n bits (0 to 63) as numbers; at moves on."""
        n = np.asarray(n, np.int64)
        got = (self(at) >> np.uint64(1)) >> (63 - n).astype(np.uint64)
        at += n
        return got.astype(np.int64)


def signed(x: np.ndarray, bits: int) -> np.ndarray:
    return (x ^ (1 << (bits - 1))) - (1 << (bits - 1))


def decode_frames(data: bytes, begins: np.ndarray, stops: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Samples (frames x BLOCK) of the frames at the given places; numbers: those that their headers must have."""
    raw = np.frombuffer(data, np.uint8)
    n = len(begins)
    if (stops - begins < 10).any() or (stops > len(raw)).any() or (begins < 0).any():
        raise Damaged("a frame outside the stream")
    check = crc16(right_aligned(raw, begins, stops - 2))
    if (check != raw[stops - 2].astype(np.uint16) << 8 | raw[stops - 1]).any():
        raise Damaged("a frame's checksum doesn't hold")
    coded, count = number_bytes(numbers)
    lead = np.concatenate([np.tile(np.array([0xFF, 0xF8, 0x24, 0x02]), (n, 1)), coded], 1)
    for k in range(10):
        if (raw[np.minimum(begins + k, len(raw) - 1)] != lead[:, k])[k < 4 + count].any():
            raise Damaged("a frame header other than mono, 8 bits, the block size and its number")
    if (crc8(right_aligned(raw, begins, begins + 4 + count)) != raw[begins + 4 + count]).any():
        raise Damaged("a frame header's checksum doesn't hold")
    bits, at = Window(data), 8 * (begins + 5 + count)
    kind = bits.take(at, 8)
    if (kind & 0x81).any():
        raise Damaged("a subframe with its first bit set or with wasted bits")
    kind >>= 1
    out = np.empty((BLOCK, n), np.int64)
    flat = np.flatnonzero(kind == CONSTANT)
    if len(flat):
        out[:, flat] = signed(bits.take(at[flat], 8), 8)
    plain = np.flatnonzero(kind == VERBATIM)
    if len(plain):
        out[:, plain] = raw[(at[plain] >> 3)[None, :] + np.arange(BLOCK)[:, None]].view(np.int8)
    rest = np.flatnonzero(kind > VERBATIM)
    if len(rest):
        out[:, rest] = predicted_frames(bits, at[rest], kind[rest])
    return out.T


def predicted_frames(bits: Window, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    n, is_lpc = len(at), kind >= 32
    if ((kind >= 2) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise Damaged("a reserved kind of subframe")
    order = np.where(is_lpc, kind - 31, kind - 8)
    most = int(order.max())
    samples, weights, shift = np.zeros((BLOCK, n), np.int64), np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    for t in range(most):
        samples[t] = signed(bits.take(at, np.where(t < order, 8, 0)), 8)
        samples[t][t >= order] = 0
    precision = bits.take(at, np.where(is_lpc, 4, 0)) + 1
    if (precision[is_lpc] == 16).any():
        raise Damaged("a reserved precision")
    shift = bits.take(at, np.where(is_lpc, 5, 0))
    if (shift > 15).any():
        raise Damaged("a negative shift")
    for j in range(most):
        here = is_lpc & (j < order)
        got = bits.take(at, np.where(here, precision, 0))
        half = np.int64(1) << (precision - 1)
        weights[j] = np.where(here, (got ^ half) - half, 0)
    for p in range(1, min(ORDER, most) + 1):
        for j, c in enumerate(FIXED[p]):
            weights[j][kind == 8 + p] = c
    method = bits.take(at, 2)
    if (method > 1).any():
        raise Damaged("a reserved coding of residuals")
    partitions = bits.take(at, 4)
    out = np.zeros((BLOCK, n), np.int64)
    for p in np.unique(partitions).tolist():
        own = np.flatnonzero(partitions == p)
        if BLOCK % (1 << p) or (BLOCK >> p) < order[own].max():
            raise Damaged("partitions that don't divide the block")
        out[:, own] = rice(bits, at[own], order[own], 4 + method[own], p)
    for t in range(BLOCK):
        guess = np.zeros(n, np.int64)
        for j in range(min(t, most)):
            guess += weights[j] * samples[t - 1 - j]
        guess >>= shift
        if t < most:
            samples[t] = np.where(t < order, samples[t], guess + out[t])
        else:
            np.add(guess, out[t], out=samples[t])
    if (samples < -128).any() or (samples > 127).any():
        raise Damaged("a sample of more than 8 bits")
    return samples


def rice(bits: Window, at: np.ndarray, order: np.ndarray, width: np.ndarray, partitions: int) -> np.ndarray:
    """Residuals (BLOCK x frames) of Rice partitions; 0 at warm-up samples."""
    n, step = len(at), BLOCK >> partitions
    out, warm = np.zeros((BLOCK, n), np.int64), int(order.max())
    one = np.uint64(1)
    for t in range(BLOCK):
        if t % step == 0:
            k = bits.take(at, width)
            escaped = k == (1 << width) - 1
            size = np.where(escaped, bits.take(at, np.where(escaped, 5, 0)), 0)
            k = np.where(escaped, 0, k)
            any_escaped = bool(escaped.any())
            low = (63 - k).astype(np.uint64)
        window = bits(at)
        high = window >> np.uint64(32)
        run = 1054 - (high.astype(np.float64).view(np.int64) >> 52)
        if (high == 0).any():
            run = np.where(high == 0, 0, run)
            for f in np.flatnonzero((high == 0) & ~(escaped | (t < order))).tolist():
                place, ones = int(at[f]), 0
                while not int(bits(np.array([place + ones]))[0]) >> 63:
                    ones += 1
                    if place + ones >= 64 * (len(bits.words) - 2):
                        raise Damaged("a code without end")
                run[f] = ones
        long = run > 30
        rest = window << np.where(long, 0, run + 1).astype(np.uint64)
        if long.any():
            rest[long] = bits(at[long] + run[long] + 1)
        u = run << k | ((rest >> one) >> low).astype(np.int64)
        value, used = (u >> 1) ^ -(u & 1), run + 1 + k
        if any_escaped:
            raw = (window >> one) >> (63 - size).astype(np.uint64)
            half = np.where(size > 0, np.int64(1) << np.maximum(size - 1, 0), 0)
            value = np.where(escaped, (raw.astype(np.int64) ^ half) - half, value)
            used = np.where(escaped, size, used)
        if t < warm:
            active = t >= order
            value, used = np.where(active, value, 0), np.where(active, used, 0)
        out[t] = value
        at += used
    return out


def metadata(stream: bytes) -> tuple[int, bytes, int, np.ndarray]:
    """Total samples, MD5, where frames begin, and the frames' offsets from there (by the seek table, or by scanning)."""
    if stream[:4] != b"fLaC":
        raise Damaged("no FLAC stream")
    at, last, total, md5, points = 4, False, None, b"", []
    while not last:
        if at + 4 > len(stream):
            raise Damaged("metadata without end")
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + n]
        if kind == 0:
            low, high = struct.unpack(">HH", block[:4])
            fields = int.from_bytes(block[10:18], "big")
            if (low, high) != (BLOCK, BLOCK) or fields >> 41 & 7 or (fields >> 36 & 31) != 7:
                raise Damaged("another block size, more than one channel, or not 8 bits")
            total, md5 = fields & (1 << 36) - 1, block[18:34]
        elif kind == 3:
            table = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
            points.append(table[table["sample"] != 0xFFFFFFFFFFFFFFFF])
        at += 4 + n
    if total is None or total % BLOCK:
        raise Damaged("no STREAMINFO, or a part of a block")
    n = total // BLOCK
    table = np.concatenate(points) if points else None
    if table is not None and len(table) == n and (table["sample"] == np.arange(n) * BLOCK).all():
        return total, md5, at, table["offset"].astype(np.int64)
    return total, md5, at, scan(np.frombuffer(stream, np.uint8)[at:], n)


def scan(raw: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n frames, found by their headers' marks, numbers and checksums."""
    found, at = [], np.flatnonzero((raw[:-3] == 0xFF) & (raw[1:-2] == 0xF8) & (raw[2:-1] == 0x24) & (raw[3:] == 0x02))
    for place in at.tolist():
        if len(found) == n:
            break
        coded, count = number_bytes(np.array([len(found)]))
        size = 4 + int(count[0])
        head = raw[place : place + size + 1]
        if len(head) == size + 1 and (head[4:size] == coded[0, : size - 4]).all() and crc8(head[:size, None])[0] == head[size]:
            found.append(place)
    if len(found) != n:
        raise Damaged("frames are missing")
    return np.array(found, np.int64)


def decode(streams: list[bytes], check_md5: bool = True) -> list[bytes]:
    """The payloads of whole streams."""
    if not streams:
        return []
    begins, stops, numbers, counts, sums, base = [], [], [], [], [], 0
    for stream in streams:
        total, md5, first, offsets = metadata(stream)
        places = base + first + offsets
        begins.append(places)
        stops.append(np.append(places[1:], base + len(stream)))
        numbers.append(np.arange(len(places)))
        counts.append(total)
        sums.append(md5)
        base += len(stream)
    data = b"".join(streams)
    begins, stops, numbers = (np.concatenate(x) for x in (begins, stops, numbers))
    parts = []
    for i in range(0, len(begins), 4096):
        a, b = int(begins[i]), int(stops[min(i + 4096, len(begins)) - 1])
        got = decode_frames(data[a:b], begins[i : i + 4096] - a, stops[i : i + 4096] - a, numbers[i : i + 4096])
        parts.append(got.astype(np.int8).tobytes())
    samples, out, at = b"".join(parts), [], 0
    for n, md5 in zip(counts, sums, strict=True):
        piece = samples[at : at + n]
        if check_md5 and hashlib.md5(piece).digest() != md5:
            raise Damaged("the samples' MD5 doesn't hold")
        out.append((np.frombuffer(piece, np.uint8) ^ 0x80).tobytes())
        at += n
    return out


def seek(stream: bytes, sample: int, count: int) -> bytes:
    """count samples from a sample on; only the frames that hold them are decoded."""
    total, _, first, offsets = metadata(stream)
    count = max(0, min(count, total - sample))
    if not count:
        return b""
    a, b = sample // BLOCK, -(-(sample + count) // BLOCK)
    places = np.append(first + offsets, len(stream))[a : b + 1]
    got = decode_frames(stream[places[0] : places[-1]], places[:-1] - places[0], places[1:] - places[0], np.arange(a, b))
    skip = sample - a * BLOCK
    return (got.astype(np.int8).reshape(-1)[skip : skip + count].view(np.uint8) ^ 0x80).tobytes()
