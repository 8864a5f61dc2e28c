"""FLAC decoding, bit by bit, against files that an encoder in this file makes."""

import random

import numpy as np
import pytest

from echolith.sources import audio
from echolith.sources.flac import crc8, crc16, decode_flac


class Writer:
    def __init__(self):
        self.bits: list[str] = []

    def put(self, value, n):
        if n:
            self.bits.append(format(value & (1 << n) - 1, f"0{n}b"))

    def unary(self, n):
        self.bits.append("0" * n + "1")

    def done(self):
        s = "".join(self.bits)
        s += "0" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8) if s else b""


def residual(w, r, order, size, parts, k, raw, wide):
    w.put(int(wide), 2)
    w.put(parts, 4)
    at = 0
    for i in range(1 << parts):
        count = (size >> parts) - (0 if i else order)
        own, at = r[at : at + count], at + count
        if raw:
            w.put(31 if wide else 15, 5 if wide else 4)
            w.put(20, 5)
            for v in own:
                w.put(v, 20)
            continue
        w.put(k, 5 if wide else 4)
        for v in own:
            z = 2 * v if v >= 0 else -2 * v - 1
            w.unary(z >> k)
            w.put(z, k)


def subframe(w, x, width, kind, rng):
    wasted = 0
    while wasted < 3 and any(x) and all(v % 2 == 0 for v in x):
        x, wasted, width = [v >> 1 for v in x], wasted + 1, width - 1
    order = {"fixed": rng.randint(0, min(4, len(x))), "lpc": rng.randint(1, min(12, len(x)))}.get(kind, 0)
    w.put(0, 1)
    w.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind], 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.unary(wasted - 1)
    parts = rng.choice([p for p in range(3) if len(x) % (1 << p) == 0 and len(x) >> p >= order])
    how = dict(size=len(x), parts=parts, k=rng.randint(0, 9), raw=rng.random() < 0.2, wide=rng.random() < 0.3)
    if kind == "constant":
        w.put(x[0], width)
    elif kind == "verbatim":
        for v in x:
            w.put(v, width)
    else:
        for v in x[:order]:
            w.put(v, width)
        if kind == "fixed":
            r = np.diff(np.array(x, object), order).tolist() if order else x
        else:
            weights, shift = [rng.randint(-40, 60) for _ in range(order)], 6
            w.put(9, 4)
            w.put(shift, 5)
            for c in weights:
                w.put(c, 10)
            r = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(weights)) >> shift) for i in range(order, len(x))]
        most = max(map(abs, r), default=0)
        how["raw"] = how["raw"] and most < 1 << 18
        if most >> how["k"] > 500:
            how |= {"wide": True, "k": most.bit_length() - 6}
        residual(w, r, order, **how)


def encoded(x, rate=16_000, depth=16, block=192, seed=0, kinds=("constant", "verbatim", "fixed", "lpc"), stereo=None):
    """A FLAC file of x (channels, samples)."""
    rng, frames = random.Random(seed), []
    for number, first in enumerate(range(0, x.shape[1], block)):
        own = [c.tolist() for c in x[:, first : first + block]]
        size, w = len(own[0]), Writer()
        mode = stereo if stereo is not None and len(own) == 2 else len(own) - 1
        w.put(0x3FFE, 14)
        w.put(0, 2)
        w.put(7, 4)
        w.put(rng.choice([0, 13]), 4)
        head_rate = int(w.bits[-1], 2)
        w.put(mode, 4)
        w.put({8: 1, 16: 4, 24: 6}[depth] if rng.random() < 0.5 else 0, 3)
        w.put(0, 1)
        head = w.done() + (bytes([number]) if number < 128 else chr(number).encode()) + (size - 1).to_bytes(2) + (rate.to_bytes(2) if head_rate else b"")
        wide = [depth] * len(own)
        if mode == 8:
            own, wide = [own[0], [a - b for a, b in zip(*own)]], [depth, depth + 1]
        elif mode == 9:
            own, wide = [[a - b for a, b in zip(*own)], own[1]], [depth + 1, depth]
        elif mode == 10:
            own, wide = [[a + b >> 1 for a, b in zip(*own)], [a - b for a, b in zip(*own)]], [depth, depth + 1]
        w = Writer()
        for c, n in zip(own, wide):
            kind = rng.choice(kinds)
            subframe(w, c, n, kind if kind != "constant" or len(set(c)) == 1 else "fixed", rng)
        frame = head + bytes([crc8(head)]) + w.done()
        frames.append(frame + crc16(frame).to_bytes(2))
    info = block.to_bytes(2) * 2 + bytes(6) + (rate << 44 | len(x) - 1 << 41 | depth - 1 << 36 | x.shape[1]).to_bytes(8) + bytes(16)
    return b"fLaC" + b"\x04\x00\x00\x03abc" + b"\x80" + len(info).to_bytes(3) + info + b"".join(frames)


def test_checksums():
    assert crc8(b"123456789") == 0xF4 and crc16(b"123456789") == 0xFEE8


@pytest.mark.parametrize("depth, channels, stereo", [(16, 1, None), (8, 1, None), (24, 1, None), (16, 2, 1), (16, 2, 8), (16, 2, 9), (24, 2, 10), (16, 3, None)])
def test_files_decode_bit_by_bit(depth, channels, stereo):
    rng, top = np.random.default_rng(depth + channels), 1 << depth - 1
    for seed in range(6):
        n = int(rng.integers(1, 1500))
        x = np.stack([np.clip((np.sin(np.arange(n) / (5 + i)) * 0.4 * top + rng.normal(0, 20, n)).astype(np.int64), -top, top - 1) for i in range(channels)])
        x[:, : n // 3] = 5 if seed % 2 else x[:, : n // 3] // 4 * 4
        x[:, -1:] = -top
        got, rate, bits = decode_flac(encoded(x, 16_000, depth, 192 if seed else 1024, seed, stereo=stereo))
        assert (got == x).all() and rate == 16_000 and bits == depth
        assert (decode_flac(encoded(x, 16_000, depth, 192, seed, stereo=stereo), n / 32_000)[0] == x[:, : int(n / 32_000 * 16_000)]).all()


def test_damaged_files_are_errors():
    x = np.random.default_rng(0).integers(-3000, 3000, (1, 700))
    whole = encoded(x)
    for at in range(60, len(whole), 37):
        bad = bytearray(whole)
        bad[at] ^= 1 << at % 8
        with pytest.raises(ValueError):
            decode_flac(bytes(bad))
    for cut in (2, 6, 30, 60, len(whole) // 2, len(whole) - 1):
        with pytest.raises(ValueError):
            decode_flac(whole[:cut])


def test_folders_of_both_kinds(spark, tmp_path):
    x = (np.sin(np.arange(3200) / 9) * 9000).astype(np.int64)
    (tmp_path / "a.flac").write_bytes(encoded(x[None], block=1024))
    (tmp_path / "b.wav").write_bytes(audio.wave_bytes(x / 32768, 16_000))
    (tmp_path / "c.flac").write_bytes(encoded(x[None])[:-9])
    (tmp_path / "d.FLAC").write_bytes(encoded(np.stack([x, x]), rate=8_000, stereo=10))
    got = {r["name"]: r for r in audio.read_audio(spark, str(tmp_path), normalise=False).collect()}
    assert np.allclose(got["a"]["x"], x / 32768, atol=1e-7) and np.allclose(got["b"]["x"], got["a"]["x"], atol=1e-4)
    assert got["c"]["x"] is None and got["c"]["error"].startswith("ValueError") and len(got["d"]["x"]) == 6400
