"""Frames written here, of every kind, decode bit for bit."""

import random

import numpy as np
import pytest

from sedge.sources import flac


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> n - 1 - k & 1 for k in range(n)]
        return self

    def rice(self, value, k):
        folded = value << 1 if value >= 0 else -value * 2 - 1
        self.bits += [0] * (folded >> k) + [1]
        return self.put(folded & (1 << k) - 1, k)

    def bytes(self):
        padded = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, padded[i : i + 8])), 2) for i in range(0, len(padded), 8))


def residual(w, r, order, size, parts, k, escaped=False):
    w.put(int(k > 14), 2).put(parts, 4)
    at = 0
    for p in range(1 << parts):
        n = (size >> parts) - (order if p == 0 else 0)
        if escaped and p == 0:
            w.put(31 if k > 14 else 15, 5 if k > 14 else 4).put(20, 5)
            for v in r[at : at + n]:
                w.put(v & (1 << 20) - 1, 20)
        else:
            w.put(k, 5 if k > 14 else 4)
            for v in r[at : at + n]:
                w.rice(v, k)
        at += n


def subframe(w, x, depth, kind, rng, wasted=0):
    w.put(0, 1)
    x = [v >> wasted for v in x]
    d = depth - wasted
    head = {"constant": 0, "verbatim": 1}.get(kind[0], (8 if kind[0] == "fixed" else 31) + kind[1] if len(kind) > 1 else 0)
    w.put(head, 6)
    w.put(1, 1).put(1, wasted) if wasted else w.put(0, 1)
    mask = (1 << d) - 1
    if kind[0] == "constant":
        w.put(x[0] & mask, d)
    elif kind[0] == "verbatim":
        for v in x:
            w.put(v & mask, d)
    else:
        order = kind[1]
        for v in x[:order]:
            w.put(v & mask, d)
        if kind[0] == "fixed":
            r = np.diff(np.array(x), order).tolist()
        else:
            weights, shift = [rng.randrange(-200, 200) for _ in range(order)], 7
            w.put(11, 4).put(shift, 5)
            for c in weights:
                w.put(c & 4095, 12)
            r = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(weights)) >> shift) for i in range(order, len(x))]
        residual(w, r, order, len(x), kind[2], kind[3], kind[4] if len(kind) > 4 else False)


def frame(number, channels, kinds, depth, mode, rng, wasted=0):
    size = len(channels[0])
    w = Writer().put(0b111111111111100, 15).put(0, 1).put(7, 4).put(5, 4).put({"left": 8, "right": 9, "middle": 10}.get(mode, len(channels) - 1), 4).put(4, 3).put(0, 1)
    if number < 128:
        w.put(number, 8)
    else:
        w.put(0b11000000 | number >> 6, 8).put(0b10000000 | number & 63, 8)
    w.put(size - 1, 16)
    w.put(flac.crc8(w.bytes()), 8)
    if mode in ("left", "right", "middle"):
        a, b = channels
        side = [p - q for p, q in zip(a, b)]
        pair = {"left": (a, side), "right": (side, b), "middle": ([p + q >> 1 for p, q in zip(a, b)], side)}[mode]
        depths = {"left": (depth, depth + 1), "right": (depth + 1, depth), "middle": (depth, depth + 1)}[mode]
    else:
        pair, depths = channels, [depth] * len(channels)
    for x, kind, d in zip(pair, kinds, depths):
        subframe(w, x, d, kind, rng, wasted)
    body = w.bytes()
    return body + flac.crc16(body).to_bytes(2, "big")


def file_of(frames, channels, total, rate=16000, depth=16):
    info = rate << 44 | channels - 1 << 41 | depth - 1 << 36 | total
    head = bytes(10) + info.to_bytes(8, "big") + bytes(16)
    comment = b"\x04\x00\x00\x05hello"
    return b"fLaC" + b"\x00" + len(head).to_bytes(3, "big") + head + bytes([comment[0] | 128]) + comment[1:] + b"".join(frames)


KINDS = [("constant",), ("verbatim",), *[("fixed", o, p, k) for o in range(5) for p, k in ((0, 6), (2, 9))], ("fixed", 2, 1, 7, True), ("fixed", 1, 0, 15), ("lpc", 1, 0, 10), ("lpc", 8, 2, 11), ("lpc", 32, 1, 16)]


@pytest.mark.parametrize("kind", KINDS, ids=str)
@pytest.mark.parametrize("mode", ["one", "two", "left", "right", "middle"])
def test_frames_decode_bit_for_bit(kind, mode):
    rng = random.Random(str((kind, mode)))
    walk = lambda: np.clip(np.cumsum([rng.randrange(-300, 301) for _ in range(256)]), -30000, 30000).tolist()
    flat = [rng.randrange(-20000, 20000)] * 256
    blocks = [[flat if kind == ("constant",) else walk() for _ in range(1 if mode == "one" else 2)] for _ in range(3)]
    if kind == ("constant",) and mode != "one":
        blocks = [[b[0], [v + 7 if b[0][0] < 0 else v - 7 for v in b[0]]] for b in blocks]
    frames = [frame(k * 70, b, [kind] * 2, 16, mode, rng) for k, b in enumerate(blocks)]
    rate, depth, got = flac.decode(file_of(frames, len(blocks[0]), 3 * 256))
    want = np.concatenate([np.array(b) for b in blocks], axis=1)
    assert (rate, depth) == (16000, 16) and (got == want).all()


def test_wasted_bits_come_back():
    rng = random.Random(1)
    x = [rng.randrange(-500, 500) << 3 for _ in range(64)]
    assert flac.decode(file_of([frame(0, [x], [("fixed", 1, 0, 8)], 16, "one", rng, wasted=3)], 1, 64))[2].tolist() == [x]


def test_files_in_spark_and_broken_ones(spark, tmp_path):
    rng = random.Random(2)
    x = [rng.randrange(-9000, 9000) for _ in range(128)]
    good = file_of([frame(0, [x, x], [("lpc", 2, 0, 12)] * 2, 16, "middle", rng)], 2, 128)
    empty = file_of([], 1, 0)
    for name, data in {"a.flac": good, "cut.flac": good[:-40], "bent.flac": good[:-20] + bytes([good[-20] ^ 1]) + good[-19:], "no.flac": b"RIFF", "empty.flac": empty, "short.flac": file_of([], 1, 9), "head.flac": b"fLaC\x00"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r for r in flac.flac_files(spark, str(tmp_path)).collect()}
    assert got["a.flac"]["rate"] == 16000 and got["a.flac"]["samples"] == pytest.approx([v / 32768 for v in x])
    assert got["empty.flac"]["samples"] == [] and got["empty.flac"]["error"] is None
    assert all(got[k]["error"] and got[k]["samples"] is None for k in ("cut.flac", "bent.flac", "no.flac", "short.flac", "head.flac"))
