"""A lossless audio column: FLAC streams of 8-bit mono samples, coded in numpy.

Frames are coded and decoded many at a time: a step of a loop handles one sample of each
of up to ``LANES`` frames.  The coder gives each frame the cheapest of a fixed predictor of
order 0 or 1, a linear predictor of order 4 with quantised coefficients, a constant and
plain samples, and Rice-codes the residuals.  The decoder finds frames by sync code,
header checksum and number, verifies every frame checksum and the stream's digest, and
reads all of these and fixed predictors up to order 4, linear ones up to 32 and any
number of Rice partitions.  A seek table gives byte offsets of sample numbers, so any
block of samples can be read without those before it.

Defined cases: a null or empty text is 64 zero bytes; equal texts have equal streams; a
damaged stream raises ``ValueError``; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textnum
from tallyframe.llm.store import written

BLOCK = 512
#: Frames from one seek point to the next.
SEEK_FRAMES = 8
LANES = 1024
ORDER, PRECISION = 4, 12
PAD = 64
#: Coefficients of the fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _table(polynomial: int, bits: int) -> np.ndarray:
    """Checksum of each byte."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.int64)
    for x in range(256):
        c = x << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ polynomial if c & top else c << 1
        out[x] = c & mask
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = int(CRC8[c ^ x])
    return c


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of byte ranges, all at once."""
    order = np.argsort(-size, kind="stable")
    start, ends = start[order], size[order]
    c = np.zeros(len(size), np.int64)
    live = len(size)
    for k in range(int(size.max(initial=0))):
        while live and ends[live - 1] <= k:
            live -= 1
        x = c[:live]
        c[:live] = ((x << 8) & 0xFFFF) ^ CRC16[(x >> 8) ^ data[start[:live] + k]]
    out = np.empty_like(c)
    out[order] = c
    return out


@lru_cache(maxsize=65536)
def frame_header(number: int, size: int) -> bytes:
    """Fixed block size, 8 kHz, mono, 8 bits."""
    code, tail = (9, b"") if size == BLOCK else (7, (size - 1).to_bytes(2, "big"))
    if number < 0x80:
        coded = bytes([number])
    else:
        more = next(k for k in range(1, 7) if number < 1 << (5 * k + 6))
        coded = bytes([((0xFF00 >> (more + 1)) & 0xFF) | (number >> (6 * more))] + [0x80 | (number >> (6 * k)) & 0x3F for k in range(more - 1, -1, -1)])
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + coded + tail
    return head + bytes([_crc8(head)])


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, ORDER), shift, and whether a frame can have them (Levinson-Durbin)."""
    f = x.astype(np.float64)
    n = x.shape[1]
    r = np.stack([np.einsum("ij,ij->i", f[:, j:], f[:, : n - j]) for j in range(ORDER + 1)], axis=1)
    good = r[:, 0] > 0
    error = np.where(good, r[:, 0] * (1 + 1e-9), 1.0)
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.abs(a).max(1)
    good &= np.isfinite(top) & (top > 0) & (top < 15)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.where(good, top, 1.0))), 0, 15).astype(np.int64)
    most = 1 << (PRECISION - 1)
    c = np.clip(np.rint(np.where(good[:, None], a, 0) * (1 << shift)[:, None]), -most, most - 1)
    return c.astype(np.int64), shift, good


def _rice(residual: np.ndarray, valid: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, parameter and size in bits of the residuals of each frame."""
    u = np.where(valid, (residual << 1) ^ (residual >> 31), 0)
    mean = u.sum(1) / np.maximum(count, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1e-9))), 0, 14).astype(np.int32)
    return u, k, (u >> k[:, None]).sum(1) + count * (1 + k)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = (value >> (width - 1 - b)) & 1


def encode_frames(samples: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames, one after another, and the size of each."""
    lanes, width = len(start), int(size.max())
    column = np.arange(width)
    inside = column < size[:, None]
    x = np.where(inside, samples[np.minimum(start[:, None] + column, len(samples) - 1)], 0).astype(np.int32)
    coefficients, shift, good = _predictors(x)
    linear = np.zeros(x.shape, np.int64)
    for j in range(ORDER):
        linear[:, ORDER:] += coefficients[:, j, None] * x[:, ORDER - 1 - j : width - 1 - j]
    linear = (x - (linear >> shift[:, None])).astype(np.int32)
    first = x.copy()
    first[:, 1:] -= x[:, :-1]
    kinds = []  # residuals, order, bits beside the residuals
    for residual, order, rest, can in ((x, 0, 10, True), (first, 1, 18, True), (linear, ORDER, 10 + 8 * ORDER + 9 + ORDER * PRECISION, good)):
        valid = inside & (column >= order)
        u, k, bits = _rice(residual, valid, size - order)
        kinds.append((u, k, np.where(can, bits + rest, 1 << 60)))
    cost = np.stack([b for _, _, b in kinds])
    best = cost.argmin(0)
    constant = ((x == x[:, :1]) | ~inside).all(1)
    verbatim = ~constant & (cost.min(0) >= 8 * size)
    coded = ~constant & ~verbatim
    order = np.where(coded, np.array([0, 1, ORDER])[best], 0)
    pick = lambda n: np.select([best == 0, best == 1], [kinds[0][n], kinds[1][n]], kinds[2][n]) if n else np.where((best == 0)[:, None], kinds[0][0], np.where((best == 1)[:, None], kinds[1][0], kinds[2][0]))
    u, k = pick(0), pick(1)
    body = np.where(constant, 8, np.where(verbatim, 8 * size, cost.min(0)))
    heads = [frame_header(n, s) for n, s in zip(number.tolist(), size.tolist())]
    head = np.array([len(h) for h in heads], np.int64)
    sizes = head + 1 + -(-body // 8) + 2
    begin = np.cumsum(sizes) - sizes
    bits = np.zeros(8 * int(sizes.sum()), np.uint8)
    at = 8 * (begin + head)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(best == 2, 32 + ORDER - 1, 8 + best)))
    _put(bits, at, kind << 1, 8)
    at = at + 8
    _put(bits, at[constant], x[constant, 0] & 0xFF, 8)
    if verbatim.any():
        rows, places = np.nonzero(inside & verbatim[:, None])
        _put(bits, at[rows] + 8 * places, x[rows, places] & 0xFF, 8)
    for j in range(ORDER):
        some = coded & (order > j)
        _put(bits, at[some] + 8 * j, x[some, j] & 0xFF, 8)
    at = at + 8 * order
    some = coded & (best == 2)
    _put(bits, at[some], np.full(int(some.sum()), PRECISION - 1), 4)
    _put(bits, at[some] + 4, shift[some], 5)
    for j in range(ORDER):
        _put(bits, at[some] + 9 + PRECISION * j, coefficients[some, j] & ((1 << PRECISION) - 1), PRECISION)
    at = at + np.where(some, 9 + PRECISION * ORDER, 0)
    _put(bits, at[coded] + 6, k[coded], 4)  # after method 0 and partition order 0
    at = at + 10
    valid = inside & (column >= order[:, None]) & coded[:, None]
    q = u >> k[:, None]
    lengths = np.where(valid, q + 1 + k[:, None], 0)
    place = at[:, None] + np.cumsum(lengths, axis=1) - lengths + q
    for kk in np.unique(k[coded]):  # frames of one parameter together
        rows = valid & (k == kk)[:, None]
        p, v = place[rows], u[rows]
        bits[p] = 1
        for b in range(int(kk)):
            bits[p + 1 + b] = (v >> (int(kk) - 1 - b)) & 1
    data = np.packbits(bits)
    for b, h in zip(begin.tolist(), heads):
        data[b : b + len(h)] = np.frombuffer(h, np.uint8)
    check = crc16(data, begin, sizes - 2)
    data[begin + sizes - 2], data[begin + sizes - 1] = check >> 8, check & 0xFF
    return data, sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (unsigned bytes, at least one)."""
    totals = np.array([len(p) for p in payloads], np.int64)
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int8)
    first = np.cumsum(totals) - totals
    many = -(-totals // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = first[owner] + BLOCK * number
    size = np.minimum(BLOCK, totals[owner] - BLOCK * number)
    frames: list[list[np.ndarray]] = [[] for _ in payloads]
    for k in range(0, len(owner), LANES):
        at = slice(k, k + LANES)
        data, sizes = encode_frames(samples, start[at], size[at], number[at])
        for o, piece in zip(owner[at].tolist(), np.split(data, np.cumsum(sizes)[:-1])):
            frames[o].append(piece)
    out = []
    for k, pieces in enumerate(frames):
        sizes = [len(x) for x in pieces]
        signed = samples[first[k] : first[k] + totals[k]].tobytes()
        least = BLOCK if len(pieces) > 1 else max(16, int(totals[k]))
        info = least.to_bytes(2, "big") + max(least, 16).to_bytes(2, "big") + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (8000 << 44 | 0 << 41 | 7 << 36 | int(totals[k])).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        seek = b"".join((BLOCK * n).to_bytes(8, "big") + int(offsets[n]).to_bytes(8, "big") + min(BLOCK, int(totals[k]) - BLOCK * n).to_bytes(2, "big") for n in range(0, len(pieces), SEEK_FRAMES))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(x.tobytes() for x in pieces))
    return out


@dataclass
class Stream:
    """What a stream's metadata says; ``seek``: (sample, offset from the first frame, samples)."""

    data: bytes
    block: int
    total: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    frames: int  # where the first frame begins


def parse(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, b"", []
    while not last:
        if len(data) < at + 4:
            raise ValueError("the metadata ends too early")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = [(int.from_bytes(body[p : p + 8], "big"), int.from_bytes(body[p + 8 : p + 16], "big"), int.from_bytes(body[p + 16 : p + 18], "big")) for p in range(0, size, 18)]
        at += 4 + size
    if len(info) != 34:
        raise ValueError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 36) & 0x1F != 7 or (packed >> 41) & 7:
        raise ValueError("not 8 bits mono")
    return Stream(data, int.from_bytes(info[2:4], "big"), packed & ((1 << 36) - 1), info[18:], seek, at)


@lru_cache(maxsize=65536)
def _header(head: bytes) -> tuple[int, int, int] | None:
    """Frame number, block size and header length, if a frame can begin so."""
    if len(head) < 6 or head[0] != 0xFF or head[1] != 0xF8 or head[3] != 0x02:
        return None
    lead = head[4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and not 1 <= more <= 6:
        return None
    number = lead if not more else lead & (0x3F >> more)
    for x in head[5 : 5 + more]:
        number = number << 6 | x & 0x3F
    at, code = 5 + more, head[2] >> 4
    if code == 6:
        size, at = head[at] + 1, at + 1
    elif code == 7:
        size, at = int.from_bytes(head[at : at + 2], "big") + 1, at + 2
    elif 8 <= code:
        size = 256 << (code - 8)
    elif 2 <= code <= 5:
        size = 576 << (code - 2)
    elif code == 1:
        size = 192
    else:
        return None
    return (number, size, at + 1) if len(head) > at and _crc8(head[:at]) == head[at] else None


def frames_of(s: Stream, first: int = 0, offset: int = 0, most: int | None = None) -> list[tuple[int, int, int, int]]:
    """(begin, end, samples, header length) of each frame from a number and an offset on."""
    out, at, number, left = [], s.frames + offset, first, s.total - first * s.block
    while left > 0 and (most is None or len(out) < most):
        head = _header(s.data[at : at + 16])
        if head is None or head[0] != number:
            raise ValueError(f"frame {number} doesn't begin where it should")
        left -= head[1]
        stop = at + head[2] + 2
        while True:
            stop = s.data.find(b"\xff\xf8", stop) if left > 0 else len(s.data)
            if stop < 0:
                raise ValueError(f"no frame {number + 1}")
            if left <= 0 or ((after := _header(s.data[stop : stop + 16])) is not None and after[0] == number + 1):
                break
            stop += 1
        out.append((at, stop, head[1], head[2]))
        at, number = stop, number + 1
    return out


def _zeros(data: np.ndarray, at: int) -> int:
    """Zero bits from a bit on."""
    first = int(data[at >> 3]) & (0xFF >> (at & 7))
    if first:
        return 8 - first.bit_length() - (at & 7)
    rest = np.flatnonzero(data[(at >> 3) + 1 :])
    if not len(rest):
        raise ValueError("a residual without an end")
    byte = int(rest[0])
    return 8 - (at & 7) + 8 * byte + 8 - int(data[(at >> 3) + 1 + byte]).bit_length()


def decode_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Samples of frames, a row each (padded behind its size)."""
    check = crc16(data, begin, end - begin - 2)
    if not np.array_equal(check, data[end - 2].astype(np.int64) << 8 | data[end - 1]):
        raise ValueError("a frame doesn't have its checksum")
    lanes, width = len(begin), int(size.max())
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    words = padded[:-8].copy()
    for j in range(1, 8):  # 64 bits from each byte on
        words = words << np.uint64(8) | padded[j : len(padded) - 8 + j]

    def bits(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        w = np.asarray(width, np.uint64)
        v = (words[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - w)
        return v.astype(np.int64)

    def signed(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v = bits(at, width)
        top = np.int64(1) << (np.asarray(width, np.int64) - 1)
        return (v ^ top) - top

    at = 8 * (begin + head)
    kind = bits(at, 8) >> 1
    at = at + 8
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not ((kind <= 1) | fixed | linear).all():
        raise ValueError("a subframe of an unknown kind")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    x = np.zeros((width, lanes), np.int64)
    constant, verbatim = kind == 0, kind == 1
    x[:, constant] = signed(at[constant], 8)
    for n in range(width if verbatim.any() else 0):
        some = verbatim & (size > n)
        x[n, some] = signed(at[some] + 8 * n, 8)
    top = int(order.max(initial=0))
    for n in range(top):
        some = order > n
        x[n, some] = signed(at[some] + 8 * n, 8)
    at = at + 8 * order
    coefficients, shift = np.zeros((max(top, 1), lanes), np.int64), np.zeros(lanes, np.int64)
    for o in np.unique(order[fixed]):
        for j, c in enumerate(FIXED[o]):
            coefficients[j, fixed & (order == o)] = c
    if linear.any():
        precision = bits(at, 4) + 1
        shift = np.where(linear, signed(at + 4, 5), 0)
        for j in range(top):
            some = linear & (order > j)
            coefficients[j, some] = signed(at[some] + 9 + precision[some] * j, precision[some])
        at = at + np.where(linear, 9 + precision * order, 0)
    # Rice residuals, then predictions, in step over all frames; longer ones first, so those in play are a prefix
    rows = np.flatnonzero(fixed | linear)
    rows = rows[np.argsort(-size[rows], kind="stable")]
    if len(rows):
        if bits(at[rows], 2).any():
            raise ValueError("a residual of an unknown kind")
        sizes, orders = size[rows], order[rows]
        y = x[:, rows]
        each = sizes >> bits(at[rows] + 2, 4)
        pos, k, turn = at[rows] + 6, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        turns = 0  # the least of turn: where a next partition begins
        in_play = np.searchsorted(-sizes, -np.arange(width), side="left")
        for n in range(width):
            m = int(in_play[n])
            if n >= turns:
                fresh = turn[:m] <= n
                k[:m] = np.where(fresh, bits(pos[:m], 4), k[:m])
                if (k[:m] == 15).any():
                    raise ValueError("an escaped partition")
                pos[:m] += 4 * fresh
                turn[:m] += each[:m] * fresh
                turns = int(turn[:m].min())
            q_at, kk = pos[:m], k[:m]
            w = words[q_at >> 3] << (q_at & 7).astype(np.uint64)
            q = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
            if q.max() >= 32:  # a run of zeros longer than a look shows
                for lane in np.flatnonzero(q >= 32).tolist():
                    q[lane] = _zeros(data, int(q_at[lane]))
            stop = q_at + q + 1
            u = (q << kk) | bits(stop, kk)
            v = (u >> 1) ^ -(u & 1)
            if n < top:
                live = orders[:m] <= n
                y[n, :m] = np.where(live, v, y[n, :m])
                pos[:m] = np.where(live, stop + kk, q_at)
            else:
                y[n, :m] = v
                pos[:m] = stop + kk
        some = np.flatnonzero(orders > 0)
        if len(some):
            z, c, s, o = y[:, some], coefficients[:, rows[some]], shift[rows[some]], orders[some]
            in_play = np.searchsorted(-sizes[some], -np.arange(width), side="left")
            for n in range(1, width):
                m = int(in_play[n])
                total = c[0, :m] * z[n - 1, :m]
                for j in range(1, min(n, top)):
                    total += c[j, :m] * z[n - 1 - j, :m]
                total >>= s[:m]
                z[n, :m] += np.where(o[:m] <= n, total, 0) if n < top else total
            y[:, some] = z
        x[:, rows] = y
    return x.T


def _samples(streams: list[Stream], frames: list[list[tuple[int, int, int, int]]]) -> list[np.ndarray]:
    """Unsigned bytes of the given frames of each stream."""
    flat = [(k, f) for k, fs in enumerate(frames) for f in fs]
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for k in range(0, len(flat), LANES):
        some = flat[k : k + LANES]
        data = np.frombuffer(b"".join(streams[o].data[f[0] : f[1]] for o, f in some), np.uint8)
        lengths = np.array([f[1] - f[0] for _, f in some], np.int64)
        end = np.cumsum(lengths)
        rows = decode_frames(data, end - lengths, end, np.array([f[2] for _, f in some], np.int64), np.array([f[3] for _, f in some], np.int64))
        if rows.size and (rows.min() < -128 or rows.max() > 127):
            raise ValueError("a sample out of range")
        rows = (rows + 128).astype(np.uint8)
        for row, (o, f) in zip(rows, some):
            out[o].append(row[: f[2]])
    return [np.concatenate(x) if x else np.zeros(0, np.uint8) for x in out]


def blocks_of(streams: list[bytes]) -> list[list[tuple[int, int | None, np.ndarray]]]:
    """Of each stream its PCM blocks, one a seek point: first sample, byte offset (null without a seek table) and samples, checked."""
    parsed = [parse(x) for x in streams]
    points = [(k, p, (s.seek[n + 1][0] if n + 1 < len(s.seek) else s.total) - p[0]) for k, s in enumerate(parsed) for n, p in enumerate(s.seek or [(0, 0, 0)])]
    found = _samples([parsed[k] for k, _, _ in points], [frames_of(parsed[k], p[0] // parsed[k].block, p[1], -(-many // parsed[k].block)) for k, p, many in points])
    out: list[list[tuple[int, int | None, np.ndarray]]] = [[] for _ in streams]
    for (k, p, _), x in zip(points, found):
        out[k].append((p[0], parsed[k].frames + p[1] if parsed[k].seek else None, x))
    for s, blocks in zip(parsed, out):
        signed = hashlib.md5()
        for _, _, x in blocks:
            signed.update((x ^ 0x80).tobytes())
        if sum(len(x) for _, _, x in blocks) != s.total or signed.digest() != s.md5:
            raise ValueError("a stream doesn't have its digest")
    return out


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The payload of each stream, checked."""
    return [np.concatenate([x for _, _, x in blocks]) for blocks in blocks_of(streams)]


def seek(data: bytes, sample: int, count: int) -> np.ndarray:
    """Some samples of a stream, read from the seek point before them."""
    s = parse(data)
    sample, count = min(sample, s.total), max(0, min(count, s.total - sample))
    point = max((p for p in s.seek if p[0] <= sample), default=(0, 0, 0))
    most = -(-(sample - point[0] + count) // s.block)
    x = _samples([s], [frames_of(s, point[0] // s.block, point[1], most)])[0]
    return x[sample - point[0] : sample - point[0] + count]


def payload_of(text: bytes) -> bytes:
    """A text with zeros up to a positive multiple of ``PAD`` bytes."""
    return text + bytes(max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    t = textnum.Texts(batch.column("text"))
    return [t.data[a:b].tobytes() for a, b in zip(t.starts.tolist(), t.ends.tolist())]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the stream of each text, and its bytes without the zeros behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                texts = _texts(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload_of(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return _rows(docs).mapInArrow(textnum.lean(run), "doc_id bigint, n_bytes bigint, media binary")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[tuple[int, int | None, np.ndarray]]]]]:
    """Parts of a media table with their streams and PCM blocks."""
    for batch in batches:
        for part in textnum.slices(batch, "media"):
            streams = [x.as_py() for x in part.column("media")]
            yield part, streams, blocks_of(streams)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, n_samples, media_offset, pcm): blocks that start at seek points, with their byte offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "block", "first_sample", "n_samples", "media_offset", "pcm"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for part, _, blocks in _streams(batches):
            rows = [(i, n, a, len(x), offset, x.tobytes()) for i, found in zip(part.column("doc_id").to_pylist(), blocks) for n, (a, offset, x) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    return media.select("doc_id", "media").mapInArrow(textnum.lean(run), "doc_id bigint, block int, first_sample bigint, n_samples int, media_offset bigint, pcm binary")


def features(x: np.ndarray) -> str:
    """Sum, energy and sign changes of the samples."""
    s = x.astype(np.int64) - 128
    return f"sum={int(s.sum())};energy={int((s * s).sum())};crossings={int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))}"


def read_back(media: DataFrame) -> DataFrame:
    """Of each stored stream: sizes and digests of the payload in its PCM blocks and of the stream itself, and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for part, streams, blocks in _streams(batches):
            rows = []
            for m, found in zip(streams, blocks):
                x = np.concatenate([x for _, _, x in found])
                b = x.tobytes()
                rows.append((len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(x)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return media.mapInArrow(textnum.lean(run), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """``read_back`` of the streams of ``docs``, which are stored as a table in the shared folder first."""
    return read_back(written(stored(docs), "media", compression="zstd"))
