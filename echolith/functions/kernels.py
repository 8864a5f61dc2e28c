"""Numpy kernels for single signals: what no built-in expression says. Each is a small function that the Arrow functions of udfs.py apply row by row."""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache
from math import ceil, gcd, log, pi, sqrt, tan

import numpy as np

EPSILON = 2.220446049250313e-16


class NoiseError(ValueError):
    """The noise floor is above the threshold."""


@cache
def butterworth(order: int, low: float | None, high: float | None, fs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth filter: low-pass without low, high-pass without high, else band-pass of twice the order."""
    proto = np.exp(1j * pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warped = [f and 2 * fs * tan(pi * f / fs) for f in (low, high)]
    if low is None:
        z, p, k = np.zeros(0), warped[1] * proto, warped[1] ** order
    elif high is None:
        z, p, k = np.zeros(order), warped[0] / proto, 1.0
    else:
        half, centre = proto * (warped[1] - warped[0]) / 2, warped[0] * warped[1]
        root = np.sqrt(half * half - centre)
        z, p, k = np.zeros(order), np.concatenate([half + root, half - root]), (warped[1] - warped[0]) ** order
    k *= (np.prod(2 * fs - z) / np.prod(2 * fs - p)).real
    more = -np.ones(len(p) - len(z))
    return np.concatenate([(2 * fs + z) / (2 * fs - z), more]), (2 * fs + p) / (2 * fs - p), k


def sections(order: int, low: float | None, high: float | None, fs: float, centre: float) -> np.ndarray:
    """The filter as second-order sections, rows (b0, b1, b2, a1, a2) with a0 = 1, each of gain 1 at the centre frequency. Conjugate poles stay together, real ones in twos; the zeros, which lie at 1 and -1, are dealt so that a band-pass section has one of each. The poles nearest to the unit circle come last."""
    z, p, _ = butterworth(order, low, high, fs)
    real, upper = np.sort(p[np.abs(p.imag) < 1e-12].real), p[p.imag >= 1e-12]
    pairs = [(q, q.conjugate()) for q in upper[np.argsort(np.abs(upper))]] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    zeros = sorted(z.real, key=lambda v: -v)
    at, out = np.exp(-2j * pi * centre / fs), []
    for pair in sorted(pairs, key=lambda pair: (len(pair) == 2, max(map(abs, pair)))):
        own = [zeros.pop(0), zeros.pop()][: len(pair)] if len(pair) == 2 else [zeros.pop()]
        b, a = np.zeros(3), np.zeros(3)
        b[: len(own) + 1], a[: len(pair) + 1] = np.poly(own).real, np.poly(pair).real
        gain = abs(np.polyval(b[::-1], at) / np.polyval(a[::-1], at))
        out.append([*(b / gain), *a[1:]])
    return np.array(out)


@cache
def _response(order: int, low: float | None, high: float | None, fs: float, size: int) -> np.ndarray:
    z, p, k = butterworth(order, low, high, fs)
    at = np.exp(2j * pi * np.arange(size // 2 + 1) / size)
    out = np.full(len(at), k, complex)
    for x in p:
        out /= at - x
    for x in z:
        out *= at - x
    return out


def filtered(x: np.ndarray, order: int, low: float | None, high: float | None, fs: float, spectra: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """The causal filter's output from rest, by its frequency response: the transform is longer than the signal by the time that the slowest pole needs to fade under double precision. spectra: the signal's by their sizes, for other filters of the same signal."""
    tail = ceil(log(1e-17) / log(np.abs(butterworth(order, low, high, fs)[1]).max()))
    size = 1 << (len(x) + tail - 1).bit_length()
    found = np.fft.rfft(x, size) if spectra is None or size not in spectra else spectra[size]
    if spectra is not None:
        spectra[size] = found
    return np.fft.irfft(found * _response(order, low, high, fs, size), size)[: len(x)]


def band_edges(band: float, fs: float, kind: str = "octave band") -> tuple[float, float | None]:
    """Low and high cut-off of a band; from 8 kHz on there is no high one."""
    ratio = {"octave band": sqrt(2), "third octave band": 2 ** (1 / 6)}.get(kind)
    if ratio is None:
        raise ValueError(f"no such kind of band: {kind}")
    if fs <= 0 or band <= 0 or band >= fs / 2 * sqrt(2):
        raise ValueError(f"band {band} Hz doesn't fit a sample rate of {fs} Hz")
    return band / ratio, band * ratio if band < 8000 else None


def band_passed(x: np.ndarray, band: float, fs: float, order: int = 4, kind: str = "octave band", spectra: dict[int, np.ndarray] | None = None) -> np.ndarray:
    if order <= 0:
        raise ValueError("the order must be positive")
    return filtered(x, order, *band_edges(band, fs, kind), fs, spectra)


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    f = np.fft.fft(x)
    f[1 : (n + 1) // 2] *= 2
    f[n // 2 + 1 :] = 0
    return np.abs(np.fft.ifft(f))


#: The resampler's filter: zeros of the sinc on each side, and its cut-off as a share of the lower rate's half.
SINC_ZEROS, SINC_CUT = 32, 0.95


@lru_cache(64)
def resampling_taps(up: int, down: int) -> tuple[int, np.ndarray]:
    """(reach, taps): for each of up phases the weights of 2 * reach samples around a place between two of them. A sinc under a Hann window, as wide as the lower rate asks for; each phase's weights add up to 1."""
    cut = SINC_CUT * min(1.0, up / down)
    reach = ceil(SINC_ZEROS / cut)
    at = np.arange(1 - reach, reach + 1)[None, :] - np.arange(up)[:, None] / up
    taps = np.sinc(cut * at) * np.where(np.abs(at) < reach, np.cos(pi * at / (2 * reach)) ** 2, 0.0)
    return reach, taps / taps.sum(axis=1, keepdims=True)


def resampled(x: np.ndarray, fs: int, rate: int) -> np.ndarray:
    """The signal at another rate: ceil(n * rate / fs) samples from its first one on, band-limited to the lower rate; zeros beyond its ends. Any whole rates: samples lie at multiples of down / up for the reduced ratio, so that a filter of up phases gives all of them."""
    up, down = ratio(fs, rate)
    return resampled_part(x, 0, 0, -(-len(x) * up // down), up, down)


def ratio(fs: int, rate: int) -> tuple[int, int]:
    if fs <= 0 or rate <= 0:
        raise ValueError("rates must be positive")
    return rate // gcd(fs, rate), fs // gcd(fs, rate)


def resampled_part(x: np.ndarray, start: int, first: int, last: int, up: int, down: int, at_once: int = 1 << 17) -> np.ndarray:
    """Samples first to last (exclusive) at up / down of the rate, of a signal of which x has what begins at start and reaches as far as their filter does; zeros elsewhere."""
    if up == down:
        return np.array(x[first - start : last - start], float)
    reach, taps = resampling_taps(up, down)
    padded = np.concatenate([np.zeros(2 * reach), x, np.zeros(2 * reach)])
    if up == 1:
        return strided_products(padded[first * down - start + reach + 1 :], taps[0], down, last - first, at_once)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach)
    rows, out = max(1, at_once // (2 * reach)), [np.zeros(0)]
    for m in range(first, last, rows):
        place = np.arange(m, min(m + rows, last)) * down
        out.append(np.einsum("ij,ij->i", windows[place // up - start + reach + 1], taps[place % up]))
    return np.concatenate(out)


def strided_products(x: np.ndarray, taps: np.ndarray, step: int, count: int, at_once: int = 1 << 17) -> np.ndarray:
    """The products of taps with x[i * step :] for i below count, zeros beyond its end. x and taps are cut into blocks of step: one product of matrices meets all blocks, and its diagonals add up, so no window is copied."""
    blocks = -(-len(taps) // step)
    own = np.concatenate([taps, np.zeros(blocks * step - len(taps))]).reshape(blocks, step).T
    rows, out = max(1, at_once // max(step, blocks) - blocks), [np.zeros(0)]
    for i in range(0, count, rows):
        n = min(rows, count - i)
        part = np.zeros((n + blocks - 1) * step)
        found = x[i * step :][: len(part)]
        part[: len(found)] = found
        met = part.reshape(-1, step) @ own
        out.append(np.lib.stride_tricks.as_strided(met, (n, blocks), (met.strides[0], met.strides[0] + met.strides[1])).sum(axis=1))
    return np.concatenate(out)


def temporal_envelope(x: np.ndarray, fs: int, rate: int = 40, size: int = 200) -> np.ndarray:
    """The envelope below rate/2 at that rate, its peak 1. ValueError unless it has size samples."""
    out = resampled(filtered(envelope(x), 4, None, rate / 2, fs), fs, rate)
    if len(out) != size:
        raise ValueError(f"{len(out)} samples instead of {size}")
    top = np.abs(out).max()
    return out / top if top > 0 else out


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Full convolution's middle part of the length of x, its peak 1."""
    size = 1 << (len(x) + len(h) - 2).bit_length()
    return middle(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size), len(x), len(h))


def middle(full: np.ndarray, n: int, m: int) -> np.ndarray:
    """Of a full convolution of n and m samples, the middle n, their peak 1."""
    return peak_normalised(full[(m - 1) // 2 :][:n])


def seed_of(*keys) -> int:
    """A seed of 63 bits, the same for the same keys."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, keys)).encode(), digest_size=8).digest()) >> 1


def pink_noise(n: int, seed: int) -> np.ndarray:
    """Noise with power falling as 1/f, its peak 1."""
    rng = np.random.default_rng(seed & (1 << 64) - 1)
    f = np.maximum(np.arange(n // 2 + 1), 1) ** -0.5
    out = np.fft.irfft(f * (rng.standard_normal(len(f)) + 1j * rng.standard_normal(len(f))), n)
    return out / np.abs(out).max()


def synthetic_response(tr: float, fs: int, seed: int) -> np.ndarray:
    """Exponentially falling noise over tr + 0.5 seconds, its peak 1."""
    rng = np.random.default_rng(seed & (1 << 64) - 1)
    n = int((tr + 0.5) * fs)
    out = np.exp(-6.9 * np.arange(n) / fs / tr) * rng.standard_normal(n)
    return out / np.abs(out).max()


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by least squares; ValueError if x doesn't vary."""
    if len(x) < 2:
        raise ValueError("a line needs two points")
    d = x - x.mean()
    slope = float(d @ (y - y.mean()) / (d @ d))
    return slope, float(y.mean() - slope * x.mean())


def _db(x):
    return 10 * np.log10(x + EPSILON)


def noise_crossing(power: np.ndarray, fs: int, block_s: float, noise_db: float) -> tuple[int, float, float]:
    """Where a decay meets its noise floor by iterated regression over block means: (sample, energy of the decay beyond it, noise floor in dB).

    The first floor is the last tenth's; NoiseError if it is above noise_db. Then blocks of a tenth of 10 dB are fitted up to 10 dB before the crossing and the floor is read 10 dB behind it, until the crossing stands still or 25 rounds are over.
    """
    n, top = len(power), power.max()
    blocks = int(n / fs / block_s)
    size = n // blocks
    mean_db = lambda count, v: _db(power[: count * v].reshape(count, v).mean(axis=1) / top)
    centres = lambda count, v: np.arange(count) * v + ceil(v / 2)
    floor = float(_db(power[round(0.9 * n) :].sum() / (0.1 * n) / top))
    if floor > noise_db:
        raise NoiseError(f"noise floor at {floor:.1f} dB")
    level = mean_db(blocks, size)
    loud = np.flatnonzero(level > floor + 10)
    if not len(loud) or loud[-1] <= 0:
        raise ValueError("no decay above the noise")
    slope, start = line(centres(blocks, size)[: loud[-1]], level[: loud[-1]])
    crossing, off, rounds = (floor - start) / slope, 1.0, 0
    path, seen = [], {}  # a round follows from crossing and slope alone, so once both come again, so do the rounds since then
    while off > 1e-4 and rounds <= 25:
        path.append((crossing, slope, start, floor))
        first = seen.setdefault((crossing, slope), rounds)
        if first < rounds:
            crossing, slope, start, floor = path[first + 1 + (25 - first) % (rounds - first)]
            break
        ten_db = abs(10 / slope)
        size = int(ten_db / 10)
        if size < 1:
            raise ValueError("the decay is too steep for blocks")
        until = n if crossing - ten_db > n else len(power[: round(crossing - ten_db)])
        count = max(until // size, 2)
        level = mean_db(count, size)
        slope, start = line(centres(count, size), level)
        behind = power[round(abs(crossing + ten_db)) :]
        if len(behind) < round(0.1 * n):
            behind = power[round(0.9 * n) :]
        floor = float(_db(behind.mean() / top))
        fresh = (floor - start) / slope
        off, crossing, rounds = abs(crossing - fresh) / crossing, round(fresh), rounds + 1
    rate = slope * log(10) / 10
    return min(int(crossing), n), float(top * 10 ** (start / 10) * np.exp(rate * crossing) / -rate), floor


def backward_energy(power: np.ndarray, stop: int, beyond: float) -> np.ndarray:
    """Energy from each sample on, up to stop, and beyond it, as a share of all."""
    own = power[:stop]
    return (np.cumsum(own[::-1]) + beyond)[::-1] / (own.sum() + beyond)


def decay_time(x: np.ndarray, fs: int, noise_db: float, drop: float = 30.0) -> tuple[float, float]:
    """(reverberation time from 5 to 5 + drop dB of the decay, noise floor in dB), the noise compensated."""
    power = (x / np.abs(x).max()) ** 2
    power = power[int(np.argmax(power)) :]
    stop, beyond, floor = noise_crossing(power, fs, 0.05, noise_db)
    curve = backward_energy(power, stop, beyond)
    curve = _db(curve / np.abs(curve).max())
    at = np.flatnonzero((curve > curve.max() - 5 - drop) & (curve <= curve.max() - 5))
    slope, _ = line(at / fs, curve[at])
    return -60 / slope, floor


def moving_max(x: np.ndarray, width: int) -> np.ndarray:
    """Largest of x[i - width//2 : i + width - width//2], within bounds; by doubling windows."""
    lead = width // 2
    x = np.concatenate([np.full(lead, -np.inf), x, np.full(width - lead - 1, -np.inf)])
    size = 1
    while 2 * size <= width:
        x, size = np.maximum(x[:-size], x[size:]), 2 * size
    return np.maximum(x[: len(x) - (width - size)], x[width - size :])


def moving_median(x: np.ndarray, width: int) -> np.ndarray:
    """Element width//2 of each sorted window of x, the ends repeated."""
    lead = width // 2
    padded = np.concatenate([np.full(lead, x[0]), x, np.full(width - lead - 1, x[-1])])
    return window_order(padded, width, lead)


def window_order(x: np.ndarray, width: int, k: int) -> np.ndarray:
    """Element k of each sorted window x[i : i + width], in len(x) steps for each bit of the number of distinct values, whatever the width: the values' ranks are sorted by one bit after the other, high bits first, stably, and every window follows the side that holds its element."""
    values, ranks = np.unique(x, return_inverse=True)
    count = len(x) - width + 1
    start, stop, left, found = np.arange(count), np.arange(count) + width, np.full(count, k), np.zeros(count, np.int64)
    for bit in reversed(range(max(len(values) - 1, 1).bit_length())):
        high = ranks >> bit & 1
        lows = np.concatenate([[0], np.cumsum(1 - high)])  # how many before each place go to the low side
        inside = lows[stop] - lows[start]
        up = left >= inside
        found |= up.astype(np.int64) << bit
        left = np.where(up, left - inside, left)
        start, stop = (np.where(up, lows[-1] + at - lows[at], lows[at]) for at in (start, stop))
        ranks = np.concatenate([ranks[high == 0], ranks[high == 1]])
    return values[found]


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Mean over x[i - width//2 : i + width - width//2], zeros beyond the ends."""
    return np.convolve(x, np.ones(width) / width, "same")


def decay_fit(t: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(amplitude, decay rate, noise floor), each within 0 and 1, of the least-squares fit of A exp(-t / tau) + n: for each tau the other two are a small linear problem."""

    n, minus = len(y), -t
    number = float if n else np.float64  # without samples numbers are to become NaN, not an error
    y1 = number(y.sum())

    def best(tau: float) -> tuple[float, float, float]:
        e = np.exp(minus / tau)
        ee, e1, ey = number(e @ e), number(e.sum()), number(e @ y)
        c0, c1, a0, a1 = (min(max(v, 0.0), 1.0) for v in (y1 / n, (y1 - e1) / n, ey / ee, (ey - e1) / ee))
        options = [(0.0, c0), (1.0, c1), (a0, 0.0), (a1, 1.0)]
        det = ee * n - e1 * e1
        if det > 0:
            a, c = (ey * n - e1 * y1) / det, (ee * y1 - e1 * ey) / det
            if 0 <= a <= 1 and 0 <= c <= 1:
                options.append((a, c))
        costs = [a**2 * ee + c**2 * n + 2 * a * c * e1 - 2 * a * ey - 2 * c * y1 for a, c in options]
        least = costs.index(min(costs)) if costs[0] == costs[0] else 0
        return costs[least], *options[least]

    grid = np.geomspace(1e-3, 1, 40)
    k = min(range(len(grid)), key=lambda i: best(grid[i])[0])
    low, high = log(grid[max(k - 1, 0)]), log(grid[min(k + 1, len(grid) - 1)])
    golden = (sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if best(np.exp(a))[0] <= best(np.exp(b))[0] else (a, high)
    tau = float(np.exp((low + high) / 2))
    _, amplitude, floor = best(tau)
    return amplitude, tau, floor


def _between(db: np.ndarray, first: float, last: float) -> np.ndarray:
    """Places from the first level under first up to the next under last."""
    start = np.flatnonzero(db < first)[0]
    return np.arange(start, start + np.flatnonzero(db[start:] < last)[0])


def envelope_crossing(x: np.ndarray) -> int:
    """Where the peak envelope of a decay meets the noise: the number of samples up to there. Levels are 10 log10 of the amplitude envelope."""
    lead = int(np.argmax(np.abs(x)))
    x = np.abs(x[lead:])
    env = moving_max(x, 160)
    db = _db(env)
    tail = lambda e: 10 * np.log10(e[-int(len(e) * 0.1) :].mean())
    floor = tail(env)
    at = _between(db, db.max(), floor + 5)
    slope, start = line(at, db[at])
    cross = int((floor - start) / slope)
    env = moving_max(x, max(int(-10 / slope / 10), 1))
    level = lambda i: db[min(i, len(db) - 1)]
    for _ in range(6):
        behind, before = cross + int(-5 / slope), level(cross)
        floor = tail(env) if behind > 0.9 * len(env) else 10 * np.log10(env[behind:].mean())
        first = floor + 5
        at = _between(db, first, db[-2] if first - 10 < db.min() else first - 10)
        slope, start = line(at, db[at])
        cross = int((floor - start) / slope)
        if abs(before - level(cross)) <= 0.2:
            break
    return lead + len(x[:cross])


def decay_parameters(x: np.ndarray, fs: int) -> tuple[int, float, float, float]:
    """(crossing, amplitude, decay rate, noise floor) of a band's late part: the model fitted to its median envelope up to the crossing."""
    cross = envelope_crossing(x)
    y = moving_median(np.abs(x), 500)[:cross]
    return cross, *decay_fit(np.linspace(0, len(y) / fs, len(y)), y)


def full_band_decay(x: np.ndarray, fs: int) -> float:
    """The decay rate of a late part, fitted to its mean envelope after its own direct sound."""
    at, k = int(np.argmax(x)), int(0.0025 * fs)
    y = moving_mean(np.abs(x[min(at + k + 1, len(x) - 1) :]), 50)
    return decay_fit(np.linspace(0, len(y) / fs, len(y)), y)[1]


def noiseless_decay(n: int, fs: int, amplitude: float, tau: float, seed: int) -> np.ndarray:
    """Falling noise by the model without its floor."""
    rng = np.random.default_rng(seed & (1 << 64) - 1)
    return amplitude * np.exp(-np.linspace(0, n / fs, n) / tau) * rng.standard_normal(n)


def peak_normalised(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max()
    return x / top if top > 0 else x


def direct_bounds(x: np.ndarray, fs: int, seconds: float = 0.0025, last: int | None = None) -> tuple[int, int]:
    """Start and stop of the samples around the signed maximum, within 0 and last (the length if not given)."""
    at, k = int(np.argmax(x)), int(seconds * fs)
    last = len(x) if last is None else last
    return min(max(at - k, 0), last), min(at + k + 1, last)


def head_and_late(x: np.ndarray, fs: int) -> tuple[np.ndarray, np.ndarray]:
    """A peak-normalised response up to the end of its direct sound, and after it."""
    x = peak_normalised(x)
    stop = direct_bounds(x, fs, last=len(x) - 1)[1]
    return x[:stop], x[stop:]


def descriptors(x: np.ndarray, fs: int, noise_db: float) -> tuple[float, float, float, float, float]:
    """t30, c50, c80, d50, drr of a band-passed response. ValueError if it is shorter than the 80 ms boundary or has no late energy."""
    t30, _ = decay_time(x, fs, noise_db)
    power = x * x
    t50, t80 = int(0.05 * fs + 1), int(0.08 * fs + 1)
    start, stop = direct_bounds(x, fs)
    early, late = power[start:stop].sum(), power[stop:].sum()
    if len(x) < t80 or late <= 0:
        raise ValueError("too short")
    clarity = lambda t: 10 * log(power[:t].sum() / (power[t:].sum() + EPSILON), 10)
    return t30, clarity(t50), clarity(t80), 100 * power[:t50].sum() / power.sum(), 10 * log(early / late, 10)


def faded(first: np.ndarray, second: np.ndarray, fs: int, at: int, seconds: float = 0.05) -> np.ndarray:
    """first, then second, blended around sample at over half of a symmetric Hann window; first itself if fewer than two windows follow."""
    n = int(seconds * fs)
    half, lead = n // 2, n // 4
    if 2 * n > len(first) - at:
        return first
    if at < lead:
        raise ValueError("the blend would start before the signal")
    hann, a = np.hanning(n), at - lead
    blend = first[a : a + half] * hann[half : 2 * half] + second[a : a + half] * hann[:half]
    return np.concatenate([first[:a], blend, second[a + half :]])


def denoised(x: np.ndarray, fs: int, crossing: int, amplitude: float, tau: float, seed: int) -> np.ndarray:
    """A band's late part whose noise gives way to its own modelled decay."""
    return faded(x, noiseless_decay(len(x), fs, amplitude, tau, seed), fs, crossing)


def rescaled(x: np.ndarray, fs: int, tr: float, tau_full: float, tau_band: float) -> np.ndarray:
    """A band's decay stretched so that the full-band decay reaches the reverberation time tr."""
    wanted = tr / log(1000) / tau_full * tau_band
    return x * np.exp(-np.linspace(0, len(x) / fs, len(x)) * (tau_band - wanted) / (tau_band * wanted))


def with_direct_ratio(x: np.ndarray, fs: int, target_db: float) -> np.ndarray:
    """The response with its direct sound weighed to a direct-to-reverberant ratio. ValueError if no weight does, or if the direct sound would end up under the late peak."""
    start, stop = direct_bounds(x, fs)
    early, late, w = x[start:stop], x[stop:], np.hamming(stop - start)
    a, b = ((w * early) ** 2).sum(), 2 * ((1 - w) * w * early**2).sum()
    c = (((1 - w) * early) ** 2).sum() - 10 ** (target_db / 10) * (late * late).sum()
    if b * b < 4 * a * c:
        raise ValueError("the ratio can't be reached")
    fresh = (-b + sqrt(b * b - 4 * a * c)) / (2 * a) * w * early + (1 - w) * early
    if np.abs(fresh).max() < np.abs(late).max():
        raise ValueError("the direct sound would end up under the late peak")
    return peak_normalised(np.concatenate([x[:start], fresh, late]))


def with_noise(x: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """x with pink noise so many dB under it."""
    noise = pink_noise(len(x), seed)
    rms = lambda v: sqrt((v * v).mean())
    return x + noise * (rms(x) / 10 ** (snr_db / 20) / rms(noise))
