"""FLAC media columns: writing and reading lossless mono streams, many frames at a time.

The writer predicts each block of 576 samples by the best of the fixed predictors and a quantised linear predictor of
order 4, Rice-codes the residuals, and closes frames with CRC-8 and CRC-16.  A seek table has a point for every frame
(first sample, byte offset), so the reader can start at any block and decodes all frames side by side: one numpy step
handles sample t of thousands of frames.  Every checksum and the stream's MD5 are verified.

`decode_stream` reads any FLAC stream of up to 8 channels (all subframe kinds, both Rice codes, stereo decorrelation),
frame after frame and without a seek table.

As a media column, a text's UTF-8 bytes, padded by bytes 255 to a positive multiple of 576, are 8-bit samples.  Null
and empty texts are one block of padding.  Equal texts give equal streams.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns

BLOCK, RATE, DEPTH = 576, 16_000, 8
#: Codes of the frame header for 576 samples, 16 kHz, mono and 8 bits.
HEADER = bytes((0xFF, 0xF8, 0x25, 0x02))
LPC_ORDER, PRECISION, SHIFT = 4, 12, 10
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
CONSTANT, VERBATIM, LINEAR = -1, -2, 5
#: Frames that are written or read side by side.
LANES = 2048


class CorruptStream(ValueError):
    pass


@cache
def crc_table(bits: int, poly: int, step: int) -> np.ndarray:
    """The remainder of every value of `step` bits."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    crc = np.arange(1 << step, dtype=np.int64) << (bits - step)
    for _ in range(step):
        crc = np.where(crc & top, (crc << 1) ^ poly, crc << 1) & mask
    return crc.astype(np.uint16)


def gathered(buffer: np.ndarray, ends: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` bytes that end at `ends`, with zeros before each row's own bytes, which leave a CRC from 0 as it is."""
    at = ends[:, None] - width + np.arange(width)
    return np.where(np.arange(width) >= (width - sizes)[:, None], buffer[np.maximum(at, 0)], 0).astype(np.uint8)


def crc16(buffer: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    width = int(sizes.max()) + 1 & ~1
    words = np.ascontiguousarray(gathered(buffer, ends, sizes, width).view(">u2").T.astype(np.uint16))
    table, crc = crc_table(16, 0x8005, 16), np.zeros(len(ends), np.uint16)
    for w in words:
        crc = table[crc ^ w]
    return crc


def crc8(buffer: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    table, crc = crc_table(8, 0x07, 8), np.zeros(len(ends), np.uint16)
    for b in gathered(buffer, ends, sizes, int(sizes.max())).T:
        crc = table[crc ^ b]
    return crc


def frame_number(n: int) -> bytes:
    """The number in the frame header's extended UTF-8."""
    if n < 0x80:
        return bytes((n,))
    more = next(k for k in range(1, 7) if n < 1 << (6 - k + 6 * k)) if n < 1 << 31 else 6
    return bytes((0xFF << (7 - more) & 0xFF | n >> (6 * more), *(0x80 | n >> (6 * k) & 0x3F for k in range(more - 1, -1, -1))))


def linear_predictors(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients for each row, by Levinson's recursion over all rows at once."""
    f = x.astype(np.float32)
    r = [np.einsum("ij,ij->i", f[:, lag:], f[:, : f.shape[1] - lag]).astype(np.float64) for lag in range(LPC_ORDER + 1)]
    r[0] = r[0] * (1 + 1e-6) + 1
    a, error = np.zeros((len(x), LPC_ORDER)), r[0].copy()
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[:, j] * r[i - j] for j in range(i))) / error
        before = a[:, :i].copy()
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -most, most).astype(np.int32)


def rice_bits(u: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row and the bits it takes."""
    n = u.shape[1] - order
    mean = u[:, order:].sum(axis=1) / n
    first = np.clip(np.log2(np.maximum(mean * 0.7, 1)).astype(np.int32), 0, 13)
    best, bits = first, None
    for k in (first, first + 1):
        own = (u[:, order:] >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (1 + k)
        best, bits = (k, own) if bits is None else (np.where(own < bits, k, best), np.minimum(own, bits))
    return best, bits


def zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def write_frames(x: np.ndarray, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of one frame for each row of 8-bit samples, end to end, and their sizes."""
    n = len(x)
    x = x.astype(np.int32)
    residuals = [x]
    for _ in range(4):
        d = residuals[-1].copy()
        d[:, 1:] -= residuals[-1][:, :-1]
        residuals.append(d)
    cost = np.stack([np.abs(r[:, 4:]).sum(axis=1) for r in residuals])
    kind = cost.argmin(axis=0)
    u = zigzag(np.stack(residuals)[kind, np.arange(n)])
    k, bits = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for order in range(5):
        rows = np.flatnonzero(kind == order)
        if len(rows):
            k[rows], bits[rows] = rice_bits(u[rows], order)
            bits[rows] += 8 * order
    coefficients = linear_predictors(x)
    guess = np.zeros_like(x)
    for j in range(LPC_ORDER):
        guess[:, LPC_ORDER:] += coefficients[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    v = zigzag(x - (guess >> SHIFT))
    kv, bv = rice_bits(v, LPC_ORDER)
    bv += 8 * LPC_ORDER + 9 + PRECISION * LPC_ORDER
    linear = bv < bits
    u[linear], k, bits = v[linear], np.where(linear, kv, k), np.minimum(bv, bits)
    kind = np.where(linear, LINEAR, kind)
    kind = np.where(bits + 10 >= DEPTH * BLOCK, VERBATIM, kind)
    kind = np.where((x == x[:, :1]).all(axis=1), CONSTANT, kind)
    order = np.where(kind == LINEAR, LPC_ORDER, np.maximum(kind, 0))
    coded = kind >= 0

    heads = [HEADER + frame_number(f) for f in numbers]
    head_size = np.array([len(h) for h in heads]) + 1
    body = np.where(coded, bits + 10, np.where(kind == CONSTANT, DEPTH, DEPTH * BLOCK)) + 8
    size = head_size + (body + 7) // 8 + 2
    starts = np.cumsum(size) - size
    out = np.zeros((int(size.sum()), 8), np.uint8)
    flat = out.reshape(-1)

    def put(rows, at, value, width: int):
        for b in range(width):
            flat[at + b] = (value >> (width - 1 - b)) & 1

    at = (starts + head_size) * 8
    code = np.select([kind == CONSTANT, kind == VERBATIM, kind == LINEAR], [0, 1, 32 + LPC_ORDER - 1], 8 + kind)
    put(None, at, code << 1, 8)
    at = at + 8
    rows = np.flatnonzero(kind == CONSTANT)
    put(rows, at[rows], x[rows, 0] & 0xFF, 8)
    rows = np.flatnonzero(kind == VERBATIM)
    for t in range(BLOCK) if len(rows) else ():
        put(rows, at[rows] + 8 * t, x[rows, t] & 0xFF, 8)
    for t in range(4):
        rows = np.flatnonzero(coded & (order > t))
        put(rows, at[rows] + 8 * t, x[rows, t] & 0xFF, 8)
    at = at + 8 * order
    rows = np.flatnonzero(kind == LINEAR)
    put(rows, at[rows], np.full(len(rows), (PRECISION - 1) << 5 | SHIFT), 9)
    for j in range(LPC_ORDER):
        put(rows, at[rows] + 9 + PRECISION * j, coefficients[rows, j] & ((1 << PRECISION) - 1), PRECISION)
    at[rows] += 9 + PRECISION * LPC_ORDER
    rows = np.flatnonzero(coded)
    put(rows, at[rows], k[rows].astype(np.int64), 10)
    if len(rows):
        kr, ur = k[rows, None], u[rows]
        q = ur >> kr
        lengths = np.where(np.arange(BLOCK) >= order[rows, None], q + 1 + kr, 0).astype(np.int32)
        ends = np.cumsum(lengths, axis=1, dtype=np.int64) + (at[rows] + 10)[:, None]
        stops = ends - 1 - kr
        own = lengths > 0
        flat[stops[own]] = 1
        for b in range(int(kr.max())):
            some = np.flatnonzero(kr[:, 0] > b)
            low = (ur[some] >> (kr[some] - 1 - b)) & 1
            set_bits = (low == 1) & own[some]
            flat[stops[some][set_bits] + 1 + b] = 1
    packed = np.packbits(flat)
    for h, s in zip(heads, starts.tolist()):
        packed[s : s + len(h)] = np.frombuffer(h, np.uint8)
    packed[starts + head_size - 1] = crc8(packed, starts + head_size - 1, head_size - 1)
    crc = crc16(packed, starts + size - 2, size - 2)
    packed[starts + size - 2], packed[starts + size - 1] = crc >> 8, crc & 0xFF
    return packed, size


def stream_head(samples: int, sizes: list[int], md5: bytes) -> bytes:
    """The marker, STREAMINFO and a seek table with a point for every frame."""
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | (DEPTH - 1) << 36 | samples).to_bytes(8, "big") + md5
    n = len(sizes)
    points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
    points["sample"], points["offset"], points["samples"] = np.arange(n) * BLOCK, np.cumsum([0, *sizes[:-1]]), BLOCK
    return b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * n).to_bytes(3, "big") + points.tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose bytes (a positive multiple of 576) are unsigned 8-bit samples."""
    if bad := [len(p) for p in payloads if not p or len(p) % BLOCK]:
        raise ValueError(f"{bad[0]} bytes aren't a positive multiple of {BLOCK}")
    counts = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    numbers = [f for n in counts for f in range(n)]
    pieces, sizes = [], []
    for low in range(0, len(samples), LANES):
        packed, size = write_frames(samples[low : low + LANES], numbers[low : low + LANES])
        pieces.append(packed.tobytes())
        sizes += size.tolist()
    frames, out, frame, at = b"".join(pieces), [], 0, 0
    for n in counts:
        own = sizes[frame : frame + n]
        md5 = hashlib.md5(samples[frame : frame + n].tobytes()).digest()
        out.append(stream_head(n * BLOCK, own, md5) + frames[at : at + sum(own)])
        frame, at = frame + n, at + sum(own)
    return out


def parse_head(stream: bytes) -> dict:
    """STREAMINFO, the seek table (or None) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise CorruptStream("no FLAC marker")
    at, last, found = 4, False, {"points": None}
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            bits = int.from_bytes(block[10:18], "big")
            found |= {"rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "depth": (bits >> 36 & 31) + 1, "samples": bits & (1 << 36) - 1, "md5": block[18:34], "block": int.from_bytes(block[:2], "big")}
        elif kind == 3:
            found["points"] = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        at += 4 + size
    return found | {"frames": at}


def read_frames(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The samples (a row of 576 each) of frames as write_frames makes them, after their checksums are verified."""
    ends = starts + sizes
    if (crc16(buffer, ends - 2, sizes - 2) != buffer[ends - 2].astype(np.uint16) << 8 | buffer[ends - 1]).any():
        raise CorruptStream("a frame's CRC-16 is wrong")
    if any((buffer[starts + i] != b).any() for i, b in enumerate(HEADER)):
        raise CorruptStream("not a frame of 576 8-bit mono samples")
    lead = buffer[starts + 4]
    head = 5 + np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    if (crc8(buffer, starts + head - 1, head - 1) != buffer[starts + head - 1]).any():
        raise CorruptStream("a frame header's CRC-8 is wrong")
    low, high = int(starts.min()), int(ends.max())
    own = np.concatenate([buffer[low:high], np.zeros(8, np.uint8)])
    bits = np.unpackbits(own)
    index = np.arange(len(bits), dtype=np.int32)
    next_one = np.minimum.accumulate(np.where(bits, index, np.int32(len(bits) - 1))[::-1])[::-1]
    wide = own.astype(np.uint32)
    words = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]

    def take(at, width):
        return ((words[at >> 3] << (at & 7).astype(np.uint32)) >> (32 - width).astype(np.uint32)).astype(np.int32)

    def take_n(at, width: int):
        return take(at, np.full(len(at), width))

    out = np.zeros((len(starts), BLOCK), np.int32)
    at = ((starts - low + head) * 8).astype(np.int64)
    code = take_n(at, 8) >> 1
    at = at + 8
    rows = np.flatnonzero(code == 0)
    out[rows] = take_n(at[rows], 8)[:, None]
    rows = np.flatnonzero(code == 1)
    for t in range(BLOCK) if len(rows) else ():
        out[rows, t] = take_n(at[rows] + 8 * t, 8)
    fixed, linear = (code >= 8) & (code <= 12), code == 32 + LPC_ORDER - 1
    if not (fixed | linear | (code <= 1)).all():
        raise CorruptStream("a predictor that this reader's fast path doesn't know")
    rows = np.flatnonzero(fixed | linear)
    if len(rows):
        at, order = at[rows], np.where(linear, LPC_ORDER, code - 8)[rows]
        x = np.zeros((BLOCK, len(rows)), np.int32)
        for t in range(4):
            x[t] = np.where(order > t, (take_n(at + 8 * t, 8) ^ 0x80) - 0x80, 0)
        at = at + 8 * order
        c = np.zeros((4, len(rows)), np.int32)
        for o in range(1, 5):
            c[:o, order == o] = np.array(FIXED[o], np.int32)[:, None]
        shift = np.zeros(len(rows), np.int32)
        some = np.flatnonzero(linear[rows])
        if len(some):
            shift[some] = take_n(at[some] + 4, 5)
            for j in range(LPC_ORDER):
                c[j, some] = (take_n(at[some] + 9 + PRECISION * j, PRECISION) ^ 1 << (PRECISION - 1)) - (1 << (PRECISION - 1))
            at[some] += 9 + PRECISION * LPC_ORDER
        if (take_n(at, 6) != 0).any():
            raise CorruptStream("a partitioned residual")
        k = take_n(at + 6, 4)
        at, width = (at + 10).astype(np.int32), k.astype(np.uint32)
        zero, down = k == 0, np.minimum(32 - width, 31).astype(np.uint32)
        for t in range(BLOCK):
            stop = next_one[at]
            here = stop + 1
            low_bits = ((words[here >> 3] << (here & 7).astype(np.uint32)) >> down).astype(np.int32)
            low_bits[zero] = 0
            u = ((stop - at) << k) | low_bits
            r = (u >> 1) ^ -(u & 1)
            if t:
                guess = c[0] * x[t - 1]
                for j in range(1, min(t, 4)):
                    guess += c[j] * x[t - 1 - j]
                r += guess >> shift
            if t < 4:
                own_rows = order <= t
                x[t], at = np.where(own_rows, r, x[t]), np.where(own_rows, here + k, at)
            else:
                x[t], at = r, here + k
        out[rows] = x.T
    raw = np.flatnonzero(code <= 1)
    out[raw] = (out[raw] ^ 0x80) - 0x80
    return out.astype(np.int8)


def decode(streams: list[bytes], first_block: int = 0, blocks: int | None = None) -> list[bytes]:
    """The payload bytes of streams that encode() made; from first_block on, sought by the seek tables."""
    parts, starts, sizes, counts, heads, at = [], [], [], [], [], 0
    for s in streams:
        head = parse_head(s)
        if head["points"] is None:
            raise CorruptStream("no seek table")
        offsets = np.append(head["points"]["offset"].astype(np.int64), len(s) - head["frames"])
        chosen = slice(first_block, None if blocks is None else first_block + blocks)
        starts.append(offsets[:-1][chosen] + at + head["frames"])
        sizes.append(np.diff(offsets)[chosen])
        counts.append(len(starts[-1]))
        heads.append(head)
        parts.append(s)
        at += len(s)
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    start, size = np.concatenate(starts), np.concatenate(sizes)
    rows = [read_frames(buffer, start[low : low + LANES], size[low : low + LANES]) for low in range(0, len(start), LANES)]
    samples = np.concatenate(rows) if rows else np.zeros((0, BLOCK), np.int8)
    out, low = [], 0
    for n, head in zip(counts, heads):
        own = samples[low : low + n]
        low += n
        if n * BLOCK == head["samples"] and hashlib.md5(own.tobytes()).digest() != head["md5"]:
            raise CorruptStream("the samples' MD5 is wrong")
        out.append((own.view(np.uint8) ^ 0x80).tobytes())
    return out


class Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise CorruptStream("the stream ends early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def decode_stream(stream: bytes) -> tuple[dict, list[list[int]]]:
    """STREAMINFO and the signed samples of every channel, of any FLAC stream."""
    head = parse_head(stream)
    bits, channels = Bits(stream, head["frames"]), [[] for _ in range(head["channels"])]
    while bits.at < 8 * len(stream):
        for own, more in zip(channels, decode_frame(stream, bits, head)):
            own += more
    return head, channels


def decode_frame(stream: bytes, bits: Bits, head: dict) -> list[list[int]]:
    first = bits.at >> 3
    if bits.take(15) != 0x7FFC:
        raise CorruptStream("no frame here")
    bits.take(1)
    size, rate, assigned, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)
    while lead & 0xC0 == 0xC0:
        bits.take(8)
        lead = lead << 1 & 0xFF
    if size in (6, 7):
        n = bits.take(8 * (size - 5)) + 1
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    if rate >= 12:
        bits.take(8 if rate == 12 else 16)
    here = bits.at >> 3
    buffer = np.frombuffer(stream, np.uint8)
    if crc8(buffer, np.array([here]), np.array([here - first]))[0] != bits.take(8):
        raise CorruptStream("a frame header's CRC-8 is wrong")
    depth = {0: head["depth"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    wide = {8: 1, 9: 0, 10: 1}.get(assigned)  # the channel that holds a difference has a bit more
    out = [decode_subframe(bits, n, depth + (c == wide)) for c in range(2 if assigned >= 8 else assigned + 1)]
    bits.at = bits.at + 7 & ~7
    here = bits.at >> 3
    if crc16(buffer, np.array([here]), np.array([here - first]))[0] != bits.take(16):
        raise CorruptStream("a frame's CRC-16 is wrong")
    if assigned == 8:
        return [out[0], [a - d for a, d in zip(*out)]]
    if assigned == 9:
        return [[d + b for d, b in zip(*out)], out[1]]
    if assigned == 10:
        return [list(c) for c in zip(*((((m << 1 | s & 1) + s) >> 1, ((m << 1 | s & 1) - s) >> 1) for m, s in zip(*out)))]
    return out


def decode_subframe(bits: Bits, n: int, depth: int) -> list[int]:
    bits.take(1)
    code, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        depth -= wasted
    if code == 0:
        out = [bits.signed(depth)] * n
    elif code == 1:
        out = [bits.signed(depth) for _ in range(n)]
    else:
        if 8 <= code <= 12:
            coefficients, shift, out = FIXED[code - 8], 0, [bits.signed(depth) for _ in range(code - 8)]
        elif code >= 32:
            out = [bits.signed(depth) for _ in range(code - 31)]
            precision, shift = bits.take(4) + 1, bits.signed(5)
            coefficients = [bits.signed(precision) for _ in range(code - 31)]
        else:
            raise CorruptStream("a reserved subframe")
        wide, partitions, order = bits.take(2), bits.take(4), len(out)
        for p in range(1 << partitions):
            k = bits.take(4 + wide)
            escaped = bits.take(5) if k == (15, 31)[wide] else None
            for _ in range((n >> partitions) - (order if p == 0 else 0)):
                if escaped is None:
                    q = bits.unary()
                    u = q << k | bits.take(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = bits.signed(escaped)
                out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coefficients)) >> shift))
    return [x << wasted for x in out] if wasted else out


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes, and how many of them are the text's."""
    data = (text or "").encode()
    return data + b"\xff" * ((-len(data)) % BLOCK if data else BLOCK), len(data)


def feature(samples: bytes) -> str:
    """samples:sum:energy:sign changes of the signed samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"{len(x)}:{int(x.sum())}:{int(x @ x)}:{int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())}"


def in_parts(texts: list[str | None], most: int = LANES * BLOCK):
    """Consecutive payloads of about `most` bytes together."""
    part, size = [], 0
    for t in texts:
        part.append(payload(t))
        size += len(part[-1][0])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media binary: each text as a FLAC stream."""

    def make():
        def run(keys, texts):
            parts = [(m, n) for part in in_parts(texts) for m, (_, n) in zip(encode([p for p, _ in part]), part)]
            return keys, [n for _, n in parts], [m for m, _ in parts]

        return run

    rows = df.select(id_col, text_col)
    return map_columns(rows, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary", make)


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, block, first_sample, pcm binary (576 unsigned 8-bit samples): a row for each block; null media have none."""

    def make():
        def run(keys, media):
            out = [(k, b, b * BLOCK, data[b * BLOCK : (b + 1) * BLOCK]) for k, m in zip(keys, media) if m for data in decode([m]) for b in range(len(data) // BLOCK)]
            return tuple(map(list, zip(*out))) if out else ([], [], [], [])

        return run

    rows = df.select(id_col, media_col)
    return map_columns(rows, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, block long, first_sample long, pcm binary", make)


def digest(docs: DataFrame) -> DataFrame:
    """Writes each text as a stream and describes what is read back from it."""

    def make():
        def run(keys, texts):
            out = []
            for part in in_parts(texts):
                media = encode([p for p, _ in part])
                for (_, n), m, data in zip(part, media, decode(media), strict=True):
                    out.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(data)))
            return keys, *(map(list, zip(*out)) if out else ([] for _ in range(7)))

        return run

    return map_columns(docs.select("doc_id", "text"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
