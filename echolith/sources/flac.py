"""Decoding of FLAC files: frames of Rice-coded residuals over fixed and linear predictors."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Sample sizes, sample rates and block sizes by their codes in a frame's header (fixed values of the format); 0: from the stream's header or after the frame's number.
_BITS = (0, 8, 12, 0, 16, 20, 24, 32)
_RATES = (0, 88_200, 176_400, 192_000, 8_000, 16_000, 22_050, 24_000, 32_000, 44_100, 48_000, 96_000)


@cache
def _crc_table(width: int, polynomial: int) -> tuple[int, ...]:
    top, mask, out = 1 << width - 1, (1 << width) - 1, []
    for byte in range(256):
        c = byte << width - 8
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return tuple(out)


def crc8(data: bytes) -> int:
    c, table = 0, _crc_table(8, 0x07)
    for b in data:
        c = table[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c, table = 0, _crc_table(16, 0x8005)
    for b in data:
        c = (c << 8 & 0xFF00) ^ table[c >> 8 ^ b]
    return c


class _Bits:
    """The bits of some bytes: numbers of up to 32 bits from any place, and the next set bit after any place, found for all places at once."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + bytes(9), np.uint8).astype(np.uint64)
        wide = sum(padded[i : len(data) + i] << np.uint64(8 * (4 - i)) for i in range(5))  # 40 bits from each byte
        self.words = ((wide[:, None] >> np.arange(8, 0, -1, dtype=np.uint64)[None, :]) & np.uint64(0xFFFFFFFF)).ravel().tolist()
        ones = np.where(np.unpackbits(np.frombuffer(data, np.uint8)), np.arange(8 * len(data)), 8 * len(data))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1].tolist()
        self.at = 0

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        out, self.at = self.words[self.at] >> 32 - n, self.at + n
        return out

    def signed(self, n: int) -> int:
        out = self.take(n)
        return out - (1 << n) if n and out >> n - 1 else out

    def unary(self) -> int:
        at = self.next_one[self.at]
        out, self.at = at - self.at, at + 1
        return out

    def rice(self, count: int, k: int) -> list[int]:
        """count numbers: a unary high part, k low bits, the sign in the lowest."""
        words, ones, at, shift, out = self.words, self.next_one, self.at, 32 - k, []
        for _ in range(count):
            one = ones[at]
            v = one - at << k
            at = one + 1 + k
            if k:
                v |= words[one + 1] >> shift
            out.append(v >> 1 ^ -(v & 1))
        self.at = at
        return out


def _residual(bits: _Bits, size: int, order: int) -> list[int]:
    method = bits.take(2)
    if method > 1:
        raise ValueError("no such coding of residuals")
    width, parts, out = 4 + method, bits.take(4), []
    for i in range(1 << parts):
        count, k = (size >> parts) - (0 if i else order), bits.take(width)
        if count < 0:
            raise ValueError("a partition is shorter than its predictor")
        if k == (1 << width) - 1:  # not Rice-coded
            n = bits.take(5)
            out += [bits.signed(n) for _ in range(count)]
        else:
            out += bits.rice(count, k)
    return out


def _subframe(bits: _Bits, size: int, width: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a subframe begins with a set bit")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    width -= wasted
    if kind == 0:
        out = np.full(size, bits.signed(width), np.int64)
    elif kind == 1:
        out = np.array([bits.signed(width) for _ in range(size)], np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        start = np.array([bits.signed(width) for _ in range(order)], np.int64)
        out = np.array(_residual(bits, size, order), np.int64)
        for k in reversed(range(order)):  # the residual is the order-th difference: add it up again, one difference after the other
            out = np.cumsum(np.concatenate([np.diff(start, k)[-1:], out]))[1:]
        out = np.concatenate([start, out])
    elif kind >= 32:
        order = kind - 31
        x = [bits.signed(width) for _ in range(order)]
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        if precision == 16 or shift < 0:
            raise ValueError("no such predictor")
        weights = [bits.signed(precision) for _ in range(order)][::-1]
        for r in _residual(bits, size, order):
            x.append(r + (sum(map(int.__mul__, weights, x[-order:])) >> shift))
        out = np.array(x, np.int64)
    else:
        raise ValueError("no such subframe")
    return out << wasted


def _number_bytes(first: int) -> int:
    """Bytes of a frame's number by its first one."""
    if first < 0x80:
        return 1
    n = 8 - (~first & 0xFF).bit_length()
    if n < 2 or n > 7:
        raise ValueError("no frame number")
    return n


def _frame(data: bytes, at: int, most: int, depth: int) -> tuple[np.ndarray, int, int, int]:
    """(samples by channel, bits a sample, sample rate or 0, where the next frame begins) of the frame at a place."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFC != 0xF8:
        raise ValueError("no frame where one should begin")
    code, rate, channels, bits = head[2] >> 4, head[2] & 15, head[3] >> 4, _BITS[head[3] >> 1 & 7] or depth
    place = 4 + _number_bytes(head[4])
    size = 192 if code == 1 else 576 << code - 2 if 2 <= code <= 5 else 256 << code - 8 if code >= 8 else 0
    if code in (6, 7):
        size, place = int.from_bytes(head[place : place + code - 5]) + 1, place + code - 5
    if rate >= 12:
        n = 1 if rate == 12 else 2
        value, place = int.from_bytes(head[place : place + n]), place + n
        hertz = value * (1000 if rate == 12 else 1 if rate == 13 else 10)
    else:
        hertz = _RATES[rate]
    if not size or channels > 10 or rate == 15 or crc8(head[:place]) != head[place]:
        raise ValueError("a damaged frame header")
    count = channels + 1 if channels < 8 else 2
    widths = [bits + ((channels, i) in ((8, 1), (9, 0), (10, 1))) for i in range(count)]
    begin, length = at + place + 1, most or size * count * (bits + 2) // 8 + 4096
    while True:
        reader = _Bits(data[begin : begin + length])
        try:
            parts = [_subframe(reader, size, width) for width in widths]
            if reader.at <= 8 * length:
                break
        except IndexError:
            pass
        if begin + length >= len(data):
            raise ValueError("a frame ends early")
        length *= 4  # residuals that are coded badly take more room than samples
    if channels == 8:
        parts[1] = parts[0] - parts[1]
    elif channels == 9:
        parts[0] = parts[0] + parts[1]
    elif channels == 10:
        middle, side = (parts[0] << 1) + (parts[1] & 1), parts[1]
        parts = [middle + side >> 1, middle - side >> 1]
    end = begin - (-reader.at // 8)
    if len(data) < end + 2 or crc16(data[at:end]) != int.from_bytes(data[end : end + 2]):
        raise ValueError("a damaged frame")
    return np.stack(parts), bits, hertz, end + 2


def decode_flac(content: bytes, seconds: float | None = None) -> tuple[np.ndarray, int, int]:
    """(samples by channel as whole numbers, sample rate, bits a sample), at most so many seconds. ValueError for what isn't FLAC or is damaged up to there."""
    if content[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, last, rate, depth, most, total = 4, False, 0, 0, 0, 0
    while not last:
        if len(content) < at + 4:
            raise ValueError("the file ends in its header")
        last, kind, size = bool(content[at] & 0x80), content[at] & 0x7F, int.from_bytes(content[at + 1 : at + 4])
        if kind == 0:
            info = content[at + 4 : at + 4 + size]
            packed = int.from_bytes(info[10:18])
            most, rate, depth, total = int.from_bytes(info[7:10]), packed >> 44, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        at += 4 + size
    if not rate:
        raise ValueError("no stream header")
    wanted, parts, have = None if seconds is None else int(seconds * rate), [], 0
    while at < len(content) and (wanted is None or have < wanted):
        x, bits, _, at = _frame(content, at, most, depth)
        parts.append(x)
        have += x.shape[1]
    if total and have < (total if wanted is None else min(total, wanted)):
        raise ValueError("the file ends early")
    return np.concatenate(parts, axis=1)[:, :wanted] if parts else np.zeros((1, 0), np.int64), rate, depth
