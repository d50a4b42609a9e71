"""FLAC files: frames of constant, verbatim, fixed and linear-prediction subframes with Rice residuals and stereo decorrelation, decoded bit for bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: samples of the block sizes and rates that a frame's header names by number, and bits of a sample.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{8 + k: 256 << k for k in range(8)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> list[int]:
    """What each leading byte adds to a checksum of so many bits."""
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        c = byte << bits - 8
        for _ in range(8):
            c = (c << 1 ^ (poly if c & top else 0)) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b]
    return c


class _Bits:
    """A reader of bits. Where the next set bit lies is worked out once, so unary numbers are one look-up."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        bit = np.unpackbits(np.frombuffer(data, np.uint8))
        self.size = len(bit)
        ones = np.flatnonzero(bit)
        if len(ones):
            following = np.searchsorted(ones, np.arange(self.size))
            self.next_one = np.where(following < len(ones), ones[np.minimum(following, len(ones) - 1)], self.size)
        else:
            self.next_one = np.full(self.size, self.size)
        self.bit = bit

    def number(self, n: int) -> int:
        end = self.at + n
        if end > self.size:
            raise FlacError("the file ends inside a frame")
        first, last = self.at >> 3, end + 7 >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (last << 3) - end & (1 << n) - 1
        self.at = end
        return value

    def signed(self, n: int) -> int:
        v = self.number(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary(self) -> int:
        if self.at >= self.size or self.next_one[self.at] >= self.size:
            raise FlacError("the file ends inside a frame")
        n = int(self.next_one[self.at]) - self.at
        self.at += n + 1
        return n

    def rice(self, count: int, k: int) -> np.ndarray:
        """`count` numbers: a unary part, then k bits; even ones are positive."""
        whole, starts = np.empty(count, np.int64), np.empty(count, np.int64)
        at, following, size = self.at, self.next_one, self.size
        for i in range(count):
            if at >= size or (one := int(following[at])) >= size:
                raise FlacError("the file ends inside a frame")
            whole[i], starts[i] = one - at, one + 1
            at = one + 1 + k
        if at > size:
            raise FlacError("the file ends inside a frame")
        self.at = at
        for b in range(k):
            whole = whole << 1 | self.bit[starts + b]
        return whole >> 1 ^ -(whole & 1)

    def align(self) -> None:
        self.at = self.at + 7 & ~7


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    width = {0: 4, 1: 5}.get(bits.number(2))
    if width is None:
        raise FlacError("no such coding of residuals")
    parts = bits.number(4)
    if size % (1 << parts) or size >> parts < order:
        raise FlacError("residuals don't fit their block")
    out = []
    for p in range(1 << parts):
        n = (size >> parts) - (order if p == 0 else 0)
        k = bits.number(width)
        if k == (1 << width) - 1:
            raw = bits.number(5)
            out.append(np.array([bits.signed(raw) for _ in range(n)], np.int64))
        else:
            out.append(bits.rice(n, k))
    return np.concatenate(out)


def _subframe(bits: _Bits, size: int, depth: int) -> np.ndarray:
    if bits.number(1):
        raise FlacError("a subframe starts with a set bit")
    kind = bits.number(6)
    wasted = bits.unary() + 1 if bits.number(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        out = np.array([bits.signed(depth) for _ in range(size)], np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = [bits.signed(depth) for _ in range(order)]
        out = np.concatenate([np.array(warm, np.int64), _residual(bits, size, order)])
        # residuals are differences of that order: each sum takes one back, from its first known value
        firsts = [out[:order].copy()]
        for _ in range(order):
            firsts.append(np.diff(firsts[-1]))
        tail = out[order:]
        for d in range(order, 0, -1):
            tail = firsts[d - 1][-1] + np.cumsum(tail)
        out[order:] = tail
    elif kind >= 32:
        order = kind - 31
        warm = [bits.signed(depth) for _ in range(order)]
        precision = bits.number(4) + 1
        if precision == 16:
            raise FlacError("no such precision")
        shift = bits.signed(5)
        if shift < 0:
            raise FlacError("a negative shift")
        weights = [bits.signed(precision) for _ in range(order)]
        values = list(warm)
        for r in _residual(bits, size, order).tolist():
            values.append(r + (sum(w * v for w, v in zip(weights, values[: -order - 1 : -1], strict=True)) >> shift))
        out = np.array(values, np.int64)
    else:
        raise FlacError("a reserved kind of subframe")
    return out << wasted


def _utf8_number(bits: _Bits) -> int:
    first = bits.number(8)
    more = 0
    while first >> 7 - more & 1:
        more += 1
    value = first & (1 << max(0, 7 - more)) - 1
    for _ in range(max(0, more - 1)):
        value = value << 6 | bits.number(8) & 63
    return value


def _frame(bits: _Bits, depth: int) -> tuple[np.ndarray, int | None]:
    """(channels, samples) of the frame at hand, and the rate that its header names."""
    start = bits.at >> 3
    if bits.number(15) != 0b111111111111100:
        raise FlacError("no frame where one should start")
    bits.number(1)
    size_code, rate_code, channel_code, depth_code = bits.number(4), bits.number(4), bits.number(4), bits.number(3)
    bits.number(1)
    _utf8_number(bits)
    size = bits.number(8) + 1 if size_code == 6 else bits.number(16) + 1 if size_code == 7 else BLOCK_SIZES.get(size_code)
    rate = bits.number(8) * 1000 if rate_code == 12 else bits.number(16) if rate_code == 13 else bits.number(16) * 10 if rate_code == 14 else RATES.get(rate_code)
    depth = SAMPLE_BITS.get(depth_code, depth)
    if size is None or channel_code > 10 or crc8(bits.data[start : bits.at >> 3]) != bits.number(8):
        raise FlacError("a broken frame header")
    if channel_code < 8:
        out = np.stack([_subframe(bits, size, depth) for _ in range(channel_code + 1)])
    else:  # left and side, side and right, middle and side: the side has one bit more
        a = _subframe(bits, size, depth + (channel_code == 9))
        b = _subframe(bits, size, depth + (channel_code != 9))
        if channel_code == 8:
            out = np.stack([a, a - b])
        elif channel_code == 9:
            out = np.stack([a + b, b])
        else:
            middle = a << 1 | b & 1
            out = np.stack([middle + b >> 1, middle - b >> 1])
    bits.align()
    if crc16(bits.data[start : bits.at >> 3]) != bits.number(16):
        raise FlacError("a frame's checksum is off")
    return out, rate


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, bits a sample, samples as integers by channel) of a FLAC file; FlacError says why there is none."""
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC file")
    at, last, info = 4, False, None
    while not last:
        if at + 4 > len(data):
            raise FlacError("the file ends in its header")
        last, kind, size = data[at] >> 7 == 1, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = int.from_bytes(data[at + 14 : at + 22], "big")
        at += 4 + size
    if info is None:
        raise FlacError("no stream information")
    rate, depth, total = info >> 44, (info >> 36 & 31) + 1, info & (1 << 36) - 1
    bits, parts = _Bits(data[at:]), []
    while bits.at < bits.size and (not total or sum(p.shape[1] for p in parts) < total):
        part, named = _frame(bits, depth)
        parts.append(part)
        rate = rate or named or 0
    samples = np.concatenate(parts, axis=1) if parts else np.zeros(((info >> 41 & 7) + 1, 0), np.int64)
    if total and samples.shape[1] < total:
        raise FlacError("samples are missing")
    return rate, depth, samples[:, :total] if total else samples


def flac_files(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples (between -1 and 1, channels averaged), error of FLAC files: a broken one keeps its row, with the reason."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rate, depth, samples = decode(bytes(content))
                    rows.append((where, rate, (samples.mean(axis=0) / (1 << depth - 1)).tolist(), None))
                except FlacError as e:
                    rows.append((where, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.flac").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("content")).mapInPandas(read, "path string, rate int, samples array<double>, error string")
