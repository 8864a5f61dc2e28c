"""The record plan: pairs in blocks against pairs one by one, rejects with reasons, the resampler."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.functions import kernels
from echolith.operators import samples
from echolith.plans import database
from echolith.sources import tables

S = database.Settings(bands=(125, 250), fs=1600, noise_db=-10.0, tr=(0.5, 1.1, 0.5), drr=(0.0, 4.0, 3.0), drr_draws=2, add_noise=True)


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(1)
    made = {f"octagon_{i}": kernels.with_noise(kernels.synthetic_response(0.6 + i / 10, S.fs, i), 35.0, i).tolist() for i in range(5)}
    rows = [(k, "train" if i % 2 else "test", i < 3, x) for i, (k, x) in enumerate(made.items())]
    rows += [("short", "train", True, [1.0, 0.5]), ("silent", "test", True, [0.0] * 3000), ("none", "train", True, None), ("empty", "train", False, [])]
    speech = [(f"sp{i}", "train" if i % 3 else "test", rng.standard_normal(5 * S.fs).tolist()) for i in range(5)] + [("brief", "train", [1.0] * 100), ("mute", "train", None)]
    return spark.createDataFrame(rows, "rir_name string, split string, augment boolean, x array<double>"), spark.createDataFrame(speech, "speech_name string, split string, x array<double>")


@pytest.mark.parametrize("block", [1, 3, 100])
def test_pairs_in_blocks_equal_pairs_one_by_one(spark, inputs, monkeypatch, block):
    monkeypatch.setattr(database, "BLOCK", block)
    got = {(r["speech_name"], r["rir_name"], r["aug_tag"], r["band"]): r for r in database.records(*inputs, S).collect()}
    every = [r.asDict() for r in database.variants(inputs[0], S).collect()]
    want = {}
    for v in every:
        for sp in inputs[1].collect():
            for band in S.bands:
                try:
                    if v["x"] is None or not v["x"] or sp["x"] is None or sp["split"] != v["split"]:
                        continue
                    x = np.array(v["x"])
                    with np.errstate(all="ignore"):
                        d = kernels.descriptors(kernels.band_passed(x, band, S.fs), S.fs, S.noise_db)
                        if not np.isfinite(d).all():
                            continue
                        seed = kernels.seed_of(sp["speech_name"], v["rir_name"], v["aug_tag"], band, S.seed)
                        snr = -5 + 25 * (seed % (1 << 30)) / (1 << 30)
                        own = kernels.with_noise(kernels.band_passed(kernels.convolved(np.array(sp["x"]), x), band, S.fs), snr, seed)
                        want[sp["speech_name"], v["rir_name"], v["aug_tag"], band] = (d, kernels.temporal_envelope(own, S.fs), snr)
                except (ValueError, ZeroDivisionError, IndexError):
                    continue
    assert got.keys() == want.keys() and len(got) > 40
    for k, (d, tae, snr) in want.items():
        r = got[k]
        assert (*r["descriptors"], r["drr"]) == pytest.approx(d) and np.allclose(r["tae"], tae, atol=1e-9) and r["snr"] == pytest.approx(snr)


def test_every_variant_and_band_is_a_record_or_a_reject(spark, inputs, tmp_path):
    path = str(tmp_path / "out")
    tables.write_outcomes(database.outcomes(*inputs, S), path)
    good, bad = tables.read_outcomes(spark, path, False), tables.read_outcomes(spark, path, True)
    variants = database.variants(inputs[0], S).select("rir_name", "aug_tag").collect()
    assert len(variants) == len(set(variants))
    told = bad.where("speech_name is null").select("rir_name", "aug_tag", "band").collect()
    paired = good.select("rir_name", "aug_tag", "band").unionByName(bad.where("speech_name is not null").select("rir_name", "aug_tag", "band")).distinct().collect()
    assert len(told) == len(set(told)) and not set(told) & set(paired) and len(told) + len(paired) == 2 * len(variants)
    errors = {(r["rir_name"], r["aug_tag"]): r["error"] for r in bad.where("speech_name is null").collect()}
    assert errors["none", "original"] == errors["empty", "original"] == errors["none", "TR_var_0.50"] == "EmptySignal" and errors["short", "TR_var_1.00"]
    assert {r["speech_name"] for r in bad.where("speech_name is not null").collect()} == {"brief", "mute"}
    files = good.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("rejected=false" in r["f"] for r in files)


def test_each_variant_has_noise_of_its_own(spark, inputs):
    rows = {r["tr"]: np.array(r["x"]) for r in database.tr_variants(inputs[0].where("rir_name = 'octagon_0'"), S).collect()}
    a, b = rows[0.5][-400:], rows[1.0][-400:]
    assert abs(np.corrcoef(a / np.abs(a).max(), b / np.abs(b).max())[0, 1]) < 0.9


@pytest.mark.parametrize("fs, rate", [(44_100, 16_000), (16_000, 40), (8_000, 16_000), (48_000, 44_100), (100, 100)])
def test_a_tone_stays_a_tone_at_another_rate(fs, rate):
    f, n = min(fs, rate) * 0.2, fs * 2 if rate > 100 else fs * 5
    out = kernels.resampled(np.sin(2 * np.pi * f * np.arange(n) / fs), fs, rate)
    assert len(out) == -(-n * rate // fs)
    want, edge = np.sin(2 * np.pi * f * np.arange(len(out)) / rate), len(out) // 4
    assert np.abs(out - want)[edge:-edge].max() < 2e-3
    high = kernels.resampled(np.sin(2 * np.pi * 0.48 * fs * np.arange(n) / fs), fs, rate)
    assert rate >= fs * 0.96 or np.abs(high[edge:-edge]).max() < 5e-3
    assert np.allclose(kernels.resampled(np.ones(n), fs, rate)[edge:-edge], 1)


def test_the_resampler_does_not_wrap_and_refuses_no_rate():
    x = np.zeros(4000)
    x[-1] = 1.0
    assert np.abs(kernels.resampled(x, 16_000, 4_000)[:200]).max() < 1e-6  # the end doesn't come round to the start
    assert len(kernels.resampled(np.zeros(0), 44_100, 16_000)) == 0
    for bad in ((0, 40), (40, 0), (-1, 5)):
        with pytest.raises(ValueError):
            kernels.resampled(x, *bad)


def test_resampling_in_blocks_equals_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(2)
    made = {1: rng.standard_normal(700), 2: rng.standard_normal(3), 3: rng.standard_normal(1)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in made.items() for i, v in enumerate(x)], "name long, n long, v double")
    for block in (1 << 16, 50, 3):
        monkeypatch.setattr(samples, "BLOCK", block)
        for fs, rate in ((100, 40), (3, 7)):
            got = {}
            for r in samples.resampled(rows, fs, rate).orderBy("name", "n").collect():
                got.setdefault(r["name"], []).append(r["v"])
            assert all(np.allclose(got[k], kernels.resampled(x, fs, rate)) for k, x in made.items())
    got = {r["name"]: r["x"] for r in samples.binned(rows, 4).collect()}
    assert np.allclose(got[1], made[1].reshape(4, 175).mean(axis=1)) and got[3] == [made[3][0], 0, 0, 0] and np.count_nonzero(got[2]) == 3
