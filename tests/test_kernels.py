"""Kernels against closed forms and plain recurrences."""

from math import log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echolith.functions import kernels as K


def test_filter_equals_the_recurrence():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(600)
    for low, high in ((None, 1000.0), (1000.0, None), (707.0, 1414.0)):
        z, p, k = K.butterworth(2, low, high, 16_000.0)
        b, a, want = k * np.real(np.poly(z)), np.real(np.poly(p)), np.zeros(len(x))
        for n in range(len(x)):
            want[n] = sum(b[i] * x[n - i] for i in range(len(b)) if n >= i) - sum(a[i] * want[n - i] for i in range(1, len(a)) if n >= i)
        assert np.allclose(K.filtered(x, 2, low, high, 16_000.0), want, atol=1e-9)


def test_filter_has_half_power_at_its_edges():
    z, p, k = K.butterworth(4, 700.0, 1400.0, 16_000.0)
    for f in (700.0, 1400.0):
        w = np.exp(2j * np.pi * f / 16_000)
        assert abs(k * np.prod(w - z) / np.prod(w - p)) ** 2 == pytest.approx(0.5, rel=1e-9)


def test_bands_that_do_not_fit_are_refused():
    for band, fs, kind in ((16_000, 16_000, "octave band"), (-1, 16_000, "octave band"), (500, 0, "octave band"), (500, 16_000, "half band")):
        with pytest.raises(ValueError):
            K.band_edges(band, fs, kind)


@pytest.mark.parametrize("tr", [0.4, 1.0, 2.0])
def test_decay_time_of_an_exponential_with_a_floor(tr):
    x = K.synthetic_response(tr, 16_000, 5)
    x = x + 1e-4 * np.random.default_rng(1).standard_normal(len(x))
    assert K.decay_time(x, 16_000, -60)[0] == pytest.approx(tr * log(1000) / 6.9, rel=0.05)


def test_noise_above_the_threshold_is_refused():
    x = K.synthetic_response(0.5, 16_000, 5)
    x = x + 3e-2 * np.random.default_rng(1).standard_normal(len(x))
    with pytest.raises(K.NoiseError):
        K.decay_time(x, 16_000, -60)


@pytest.mark.parametrize("n, ok", [(79_600, False), (79_601, True), (80_000, True), (80_001, False)])
def test_envelope_feature_has_200_samples_or_fails(n, ok):
    x = np.random.default_rng(0).standard_normal(n)
    if ok:
        assert len(out := K.temporal_envelope(x, 16_000)) == 200 and np.abs(out).max() == 1
    else:
        with pytest.raises(ValueError):
            K.temporal_envelope(x, 16_000)


def test_envelope_feature_follows_a_modulator():
    t = np.arange(80_000) / 16_000
    out = K.temporal_envelope((1 + 0.8 * np.sin(2 * np.pi * 4 * t)) * np.sin(2 * np.pi * 1000 * t), 16_000)
    assert np.argmax(np.abs(np.fft.rfft(out[40:] - out[40:].mean()))) == 4 * 160 // 40


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-9, 9), min_size=1, max_size=60), st.integers(1, 20))
def test_moving_windows(values, width):
    x = np.array(values)
    n, lead = len(x), width // 2
    want = [max(x[max(i - lead, 0) : i + width - lead]) for i in range(n)]
    assert K.moving_max(x, width).tolist() == want
    padded = [x[min(max(j, 0), n - 1)] for j in range(-lead, n + width)]
    assert K.moving_median(x, width).tolist() == [sorted(padded[i : i + width])[lead] for i in range(n)]


def test_decay_fit_finds_its_own_model():
    t = np.linspace(0, 2, 4000)
    assert K.decay_fit(t, 0.6 * np.exp(-t / 0.21) + 0.03) == pytest.approx((0.6, 0.21, 0.03), rel=1e-3)


def test_direct_ratio_is_reached():
    x = K.synthetic_response(0.5, 16_000, 2)
    x = np.concatenate([np.zeros(100), [1.0], 0.2 * x])
    y = K.with_direct_ratio(x, 16_000, 8.0)
    start, stop = K.direct_bounds(y, 16_000)
    assert 10 * np.log10((y[start:stop] ** 2).sum() / (y[stop:] ** 2).sum()) == pytest.approx(8.0, abs=1e-9)


def test_noise_is_at_its_ratio_and_repeatable():
    x = np.sin(np.arange(5000) / 7)
    y = K.with_noise(x, 12.0, 4)
    assert 10 * np.log10((x**2).mean() / ((y - x) ** 2).mean()) == pytest.approx(12.0, abs=1e-9)
    assert (y == K.with_noise(x, 12.0, 4)).all() and (y != K.with_noise(x, 12.0, 5)).any()


def test_convolution_is_the_middle_part():
    x, h = np.random.default_rng(0).standard_normal(50), np.random.default_rng(1).standard_normal(21)
    want = np.convolve(x, h)[10:60]
    assert np.allclose(K.convolved(x, h), want / np.abs(want).max())


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("low, high, centre", [(707.0, 1414.0, 1000.0), (None, 1000.0, 500.0), (5657.0, None, 8000.0)])
def test_sections_have_the_filters_response_and_unit_gain_at_the_centre(order, low, high, centre):
    z, p, k = K.butterworth(order, low, high, 22_050.0)
    rows = K.sections(order, low, high, 22_050.0, centre)
    whole = lambda w: k * np.prod(w - z) / np.prod(w - p)
    part = lambda w, r: (r[0] + r[1] / w + r[2] / w**2) / (1 + r[3] / w + r[4] / w**2)
    at = lambda f: np.exp(2j * np.pi * f / 22_050)
    assert all(abs(part(at(centre), r)) == pytest.approx(1) for r in rows)
    for f in (50.0, 400.0, 1200.0, 6000.0, 10_000.0):
        assert np.prod([part(at(f), r) for r in rows]) / np.prod([part(at(centre), r) for r in rows]) == pytest.approx(whole(at(f)) / whole(at(centre)), rel=1e-7)
    assert len(rows) == -(-len(p) // 2) and all(np.abs(np.roots([1, *r[3:]])).max() < 1 for r in rows)


def test_a_table_of_sections(spark):
    from echolith.sources.tables import filter_table

    rows = filter_table(spark, (125, 1000, 8000), 22_050, 4).collect()
    assert {b: sum(r["band"] == b for r in rows) for b in (125, 1000, 8000)} == {125: 4, 1000: 4, 8000: 2}
