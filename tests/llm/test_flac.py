import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import flac


def plain(data):
    """A decoder that reads one bit after another, written from the format alone."""
    s = flac.parse(data)
    bits = "".join(f"{x:08b}" for x in data[s.frames :])
    at = 0

    def take(n, sign=False):
        nonlocal at
        v = int(bits[at : at + n], 2) if n else 0
        at += n
        return v - (1 << n) if sign and n and v >> (n - 1) else v

    out = []
    while len(out) < s.total:
        begin = at
        assert take(15) == 0b111111111111100 and take(1) == 0
        code, rate, channels, depth, _ = take(4), take(4), take(4), take(3), take(1)
        assert (rate, channels, depth) == (4, 0, 1)
        lead = take(8)
        for _ in range(0 if lead < 128 else f"{lead:08b}".index("0") - 1):
            take(8)
        n = {9: 512}[code] if code != 7 else take(16) + 1
        take(8)
        kind = take(8) >> 1
        if kind == 0:
            x = [take(8, True)] * n
        elif kind == 1:
            x = [take(8, True) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [take(8, True) for _ in range(order)]
            c, shift = flac.FIXED[order] if kind < 32 else None, 0
            if c is None:
                precision, shift = take(4) + 1, take(5, True)
                c = [take(precision, True) for _ in range(order)]
            assert take(2) == 0 and take(4) == 0
            k = take(4)
            while len(x) < n:
                stop = bits.index("1", at)
                q, at = stop - at, stop + 1
                u = q << k | take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(a * b for a, b in zip(c, reversed(x))) >> shift))
        at += -at % 8
        crc = 0
        for b in range((at - begin) // 8):
            crc ^= int(bits[begin + 8 * b : begin + 8 * b + 8], 2) << 8
            for _ in range(8):
                crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        assert take(16) == crc
        out += x
    return bytes(v + 128 for v in out)


def payloads():
    rng = random.Random(1)
    words = ["the", "anon", "réeux", "ß", "!!", "\n", "ERTION"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    raw = [b"", b"x", text(3), text(100), text(900), b"a" * 700, bytes(rng.randrange(256) for _ in range(1500)), bytes(range(256)) * 6, b"\x00\xff" * 400, b"a" * 500 + b"\xff" + b"a" * 600, bytes(k // 9 % 256 for k in range(3000))]
    return [flac.payload_of(x) for x in raw]


def test_round_trip_and_a_plain_decoder():
    p = payloads()
    streams = flac.encode(p)
    assert [x.tobytes() for x in flac.decode(streams)] == p
    assert [plain(x) for x in streams] == p
    assert flac.encode(p[::-1]) == streams[::-1]  # a stream depends on its text alone


def test_long_streams_and_seeking():
    long = flac.payload_of(bytes(np.random.default_rng(0).integers(90, 120, 1_200_000, dtype=np.uint8)))
    (stream,) = flac.encode([long])
    assert flac.decode([stream])[0].tobytes() == long
    for a, n in ((0, 10), (4095, 3), (700_001, 9000), (len(long) - 5, 50), (len(long), 4)):
        assert flac.seek(stream, a, n).tobytes() == long[a : a + n]


def test_damage_is_found():
    p = payloads()[4]
    (stream,) = flac.encode([p])
    rng = random.Random(2)
    for _ in range(60):
        at = rng.randrange(flac.parse(stream).frames, len(stream))
        bad = bytearray(stream)
        bad[at] ^= 1 << rng.randrange(8)
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    for cut in (3, 30, 60, len(stream) - 1):
        with pytest.raises(ValueError):
            flac.decode([stream[:cut]])


def test_rows(spark):
    texts = [None, "", "abc", "é" * 64, "the " * 5000, "abc", "x" * 64]
    rows = [(i, t, b"clash") for i, t in enumerate(texts)] + [(None, "abc", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in flac.digests(frame).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[2][1:] == got[5][1:] == got[None][1:]
    blocks = flac.pcm_blocks(flac.stored(frame)).where("doc_id = 4").orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks)[:20000] == texts[4].encode() and all(b.media_offset for b in blocks)
    assert flac.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
