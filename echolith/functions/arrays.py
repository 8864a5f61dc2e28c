"""Signal measures as built-in column expressions over array columns; nothing leaves the JVM.

Samples are numbered from 0. A null array gives null; so does an array too short for what is asked.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to late energy so that a quiet tail doesn't divide by zero.
EPSILON = 2.220446049250313e-16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: an expression used inside a lambda, or several times over, would be worked out each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def energy(x: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def rms(x: Column) -> Column:
    """Root mean square; null for an empty array."""
    return F.sqrt(energy(x) / F.nullif(F.size(x), F.lit(0)))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def peak_normalise(x: Column) -> Column:
    """Divided by the largest magnitude; silence stays as it is."""
    pair = let(x, lambda y: F.struct(y.alias("y"), peak(y).alias("top")))
    return let(pair, lambda p: F.when(p["top"] > 0, F.transform(p["y"], lambda v: v / p["top"])).otherwise(p["y"]))


def mixed(x: Column, other: Column, gain: Column) -> Column:
    """x plus gain times other, sample by sample."""
    given = F.struct(x.alias("x"), other.alias("other"), gain.alias("gain"))
    return let(given, lambda p: F.zip_with(p["x"], p["other"], lambda a, b: a + p["gain"] * b))


def argmax(x: Column) -> Column:
    """Place of the first largest sample."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def part(x: Column, start: Column, stop: Column) -> Column:
    """Samples start to stop, the latter exclusive."""
    return F.slice(x, start + 1, F.greatest(stop - start, F.lit(0)))


def boundary(time_ms: float, fs: int) -> int:
    """Samples of the early part."""
    return int(time_ms / 1000 * fs + 1)


def clarity(x: Column, time_ms: float, fs: int) -> Column:
    """Early to late energy in dB, the boundary counted from the first sample; null if the signal ends before it."""
    t = boundary(time_ms, fs)
    early, late = energy(F.slice(x, 1, t)), energy(F.slice(x, t + 1, F.greatest(F.size(x) - t, F.lit(0))))
    return F.when(F.size(x) >= t, 10 * F.log10(early / (late + EPSILON)))


def definition(x: Column, fs: int, time_ms: float = 50) -> Column:
    """Early energy in percent of all; NaN for silence, null if the signal ends before the boundary."""
    t = boundary(time_ms, fs)
    share = F.when(energy(x) > 0, 100 * energy(F.slice(x, 1, t)) / energy(x)).otherwise(F.lit(float("nan")))
    return F.when(F.size(x) >= t, share)


def direct_window(x: Column, fs: int, seconds: float) -> tuple[Column, Column]:
    """Start and stop (exclusive) of the samples around the signed maximum, within the signal."""
    k, at = int(seconds * fs), argmax(x)
    return F.greatest(at - k, F.lit(0)), F.least(at + k + 1, F.size(x))


def direct_to_reverberant(x: Column, fs: int, seconds: float = 0.0025) -> Column:
    """Energy around the direct sound to that after it, in dB; what precedes belongs to neither. Null if there is no late energy."""
    start, stop = direct_window(x, fs, seconds)
    early, late = energy(part(x, start, stop)), energy(part(x, stop, F.size(x)))
    return F.when((late > 0) & (early > 0), 10 * F.log10(early / late))


def temporal_parts(x: Column, fs: int, seconds: float = 0.0025) -> Column:
    """struct<delay, early, late>: before, around and after the signed maximum, bounds kept within 0 and the last sample."""
    k = int(seconds * fs)

    def cut(p: Column) -> Column:
        y, last = p["y"], F.size(p["y"]) - 1
        start, stop = F.least(F.greatest(p["at"] - k, F.lit(0)), last), F.least(F.greatest(p["at"] + k + 1, F.lit(0)), last)
        return F.struct(part(y, F.lit(0), start).alias("delay"), part(y, start, stop).alias("early"), part(y, stop, F.size(y)).alias("late"))

    return let(let(x, lambda y: F.struct(y.alias("y"), argmax(y).alias("at"))), cut)


def snr_db(rms_signal: Column, rms_noise: Column) -> Column:
    return 10 * F.log10(rms_signal * rms_signal / (rms_noise * rms_noise))


def noise_gain(rms_signal: Column, rms_noise: Column, snr: Column) -> Column:
    """The factor that brings noise to so many dB under the signal."""
    return F.sqrt(rms_signal * rms_signal / F.pow(F.lit(10.0), snr / 10)) / rms_noise


def larger_root(a: Column, b: Column, c: Column) -> Column:
    """The larger real root of a quadratic; null if there is none."""
    r = b * b - 4 * a * c
    return F.when(r >= 0, F.greatest((-b + F.sqrt(r)) / (2 * a), (-b - F.sqrt(r)) / (2 * a)))


def hamming(n: Column) -> Column:
    """A symmetric Hamming window of n samples (1 for a single one)."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n > 1, 0.54 - 0.46 * F.cos(2 * pi * i / (n - 1))).otherwise(1.0))


def direct_gain(early: Column, late: Column, target_db: Column) -> Column:
    """The weight of the windowed direct sound that makes its energy target_db over the late one: w blends the scaled and the original samples, so the energy is a quadratic in the weight. Null if no weight does."""
    terms = F.zip_with(early, hamming(F.size(early)), lambda e, w: F.struct((w * w * e * e).alias("a"), ((1 - w) * w * e * e).alias("b"), ((1 - w) * (1 - w) * e * e).alias("c")))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in "abc"))
    sums = F.aggregate(terms, zero, lambda s, t: F.struct(*((s[k] + t[k]).alias(k) for k in "abc")))
    wanted = F.pow(F.lit(10.0), target_db / 10) * energy(late)
    return let(F.struct(sums.alias("s"), wanted.alias("w")), lambda p: larger_root(p["s"]["a"], 2 * p["s"]["b"], p["s"]["c"] - p["w"]))


def with_direct_ratio(x: Column, fs: int, target_db: Column, seconds: float = 0.0025) -> Column:
    """The signal with its direct sound rescaled to a direct-to-reverberant ratio, peak-normalised. Null if it can't be reached, or if the direct sound would end up under the late part's peak."""

    def cut(y: Column) -> Column:
        start, stop = direct_window(y, fs, seconds)
        return F.struct(part(y, F.lit(0), start).alias("delay"), part(y, start, stop).alias("early"), part(y, stop, F.size(y)).alias("late"))

    def weighed(p: Column) -> Column:
        return F.struct(p.alias("p"), hamming(F.size(p["early"])).alias("w"), direct_gain(p["early"], p["late"], target_db).alias("gain"))

    def blended(q: Column) -> Column:
        fresh = F.zip_with(q["p"]["early"], q["w"], lambda e, w: q["gain"] * w * e + (1 - w) * e)
        return F.struct(q["p"].alias("p"), fresh.alias("fresh"))

    def joined(q: Column) -> Column:
        loud = peak(q["fresh"]) >= peak(q["p"]["late"])  # null, like fresh, without a gain
        return F.when(loud, peak_normalise(F.concat(q["p"]["delay"], q["fresh"], q["p"]["late"])))

    return let(let(let(let(x, cut), weighed), blended), joined)


def decay_rescale(x: Column, fs: int, tr: Column, tau_full: Column, tau_band: Column) -> Column:
    """A band's decay stretched so that the full-band decay reaches the reverberation time tr. Time runs from 0 to n/fs, end included."""
    wanted = tr / F.log(F.lit(1000.0)) / tau_full * tau_band
    given = F.struct(x.alias("x"), ((tau_band - wanted) / (tau_band * wanted)).alias("rate"), (F.size(x) / F.lit(float(fs)) / F.greatest(F.size(x) - 1, F.lit(1))).alias("step"))
    return let(given, lambda p: F.transform(p["x"], lambda v, i: v * F.exp(-i * p["step"] * p["rate"])))


def cross_fade(first: Column, second: Column, fs: int, at: Column, seconds: float = 0.05) -> Column:
    """first, then second, blended around sample at over half of a symmetric Hann window of the given length (an even number of samples). first itself if fewer than two such lengths follow; null if the blend would start before the signal."""
    n = int(seconds * fs)
    half, lead = n // 2, n // 4
    hann = lambda i: 0.5 - 0.5 * F.cos(2 * pi * i / max(n - 1, 1))

    def faded(p: Column) -> Column:
        def mix(q: Column, i: Column) -> Column:
            k = i - (p["at"] - lead)  # place in the blend
            return F.when(k < 0, q["a"]).when(k >= half, q["b"]).otherwise(q["a"] * hann(k + half) + q["b"] * hann(k))

        pairs = F.zip_with(p["first"], p["second"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.when(2 * n > F.size(p["first"]) - p["at"], p["first"]).when(p["at"] >= lead, F.transform(pairs, mix))

    return let(F.struct(first.alias("first"), second.alias("second"), at.alias("at")), faded)


def half_even(x: Column, digits: int = 2) -> Column:
    """Rounded half to even on the scaled double."""
    return F.rint(x * 10**digits) / 10**digits
