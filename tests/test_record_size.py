"""The record plan at size: what Python holds grows with neither a batch's rows nor their variants, and a response is made, fitted and described in one pass."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_database import S, inputs  # noqa: F401

from echolith.functions import kernels, udfs
from echolith.plans import database


def test_a_batch_of_keys_becomes_pieces_of_signals(monkeypatch):
    monkeypatch.setattr(udfs, "MADE_BYTES", 1 << 16)
    kinds = pa.schema([("k", pa.int64()), ("x", pa.list_(pa.float64()))])
    keys = [pa.RecordBatch.from_pydict({"k": list(range(i, i + 50))}) for i in (0, 50)]
    got = list(udfs.pieces(iter(keys), lambda k: ((k, np.full(n, float(k)) if n else None) for n in (0, 1000)), kinds))
    assert len(got) > 10 and max(b.nbytes for b in got) < (1 << 16) + 9000
    rows = [(r["k"], r["x"]) for b in got for r in b.to_pylist()]
    assert [k for k, _ in rows] == [k for k in range(100) for _ in range(2)] and all(x is None if i % 2 == 0 else x == [float(k)] * 1000 for i, (k, x) in enumerate(rows))


def test_signals_go_through_one_function_in_pieces(spark, inputs):  # noqa: F811
    kept = []
    database.outcomes(*inputs, S, keep=lambda df: kept.append(df) or df)
    plan = "".join(df._jdf.queryExecution().toString() for df in kept).partition("== Physical Plan ==")[2]
    assert len(kept) == 1 and plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_variants_described_in_one_pass_equal_those_described_later(spark, inputs):  # noqa: F811
    rows = database.every_variant(inputs[0], S).cache()
    later = {(r["rir_name"], r["aug_tag"], r["band"]): r for r in database.described(database.variants(inputs[0], S), S).collect()}
    good = rows.select("rir_name", "aug_tag", F.explode("measures").alias("m")).select("rir_name", "aug_tag", "m.band", "m.descriptors.*", "m.drr", F.lit(None).alias("error")).collect()
    bad = rows.select("rir_name", "aug_tag", F.explode("rejects").alias("r")).select("rir_name", "aug_tag", "r.*").collect()
    assert good and bad and len(good) + len(bad) == len(later) and {(r["rir_name"], r["aug_tag"], r["band"]) for r in good + bad} == later.keys()
    for r in good:
        assert all(r[c] == later[r["rir_name"], r["aug_tag"], r["band"]][c] for c in ("t30", "c50", "c80", "d50", "drr", "error"))
    assert all(r["error"] == later[r["rir_name"], r["aug_tag"], r["band"]]["error"] for r in bad)
    assert rows.where("(x is null) != (size(measures) = 0)").count() == 0


def test_a_response_that_is_made_equals_the_same_given(spark):
    keys = spark.range(6).select(F.concat(F.lit("hall_"), "id").alias("rir_name"), F.lit("train").alias("split"), (F.col("id") % 2 == 0).alias("augment"), (F.col("id") / 10 + 0.4).alias("tr"), F.col("id").alias("seed"))
    given = udfs.with_synthetic_response(keys, S.fs, 35.0).select("rir_name", "split", "augment", "x")
    own = ["rir_name", "aug_tag", "x", "error"]
    made = database.variants(keys, S, udfs.synthetic(S.fs, 35.0)).select(*own).collect()
    assert len(made) > 12 and sorted(made, key=lambda r: r[:2]) == sorted(database.variants(given, S).select(*own).collect(), key=lambda r: r[:2])
    lengths = database.tr_variants(keys, S, udfs.synthetic(S.fs, 35.0), "n int", lambda y: (None if y is None else len(y),)).select("rir_name", "tr", "n").collect()
    assert sorted(lengths) == sorted(database.tr_variants(given, S).select("rir_name", "tr", F.size("x").alias("n")).collect())


def test_speech_is_copied_for_few_blocks_of_responses(spark, monkeypatch):
    given, sizes = database._in_blocks, []
    monkeypatch.setattr(database, "_in_blocks", lambda rows, found, *more: sizes.append(found) or given(rows, found, *more))
    cores = spark.sparkContext.defaultParallelism
    dealt = lambda n: spark.range(n).select(F.lit("train").alias("split"), F.concat(F.lit("r"), "id").alias("rir_name"), F.lit("original").alias("aug_tag"), F.array(F.lit(1.0)).alias("h"), F.array(F.struct(F.lit(125).alias("band"))).alias("measures"))
    speech = spark.range(5).select(F.lit("train").alias("split"), F.concat(F.lit("s"), "id").alias("speech_name"), F.array(F.lit(1.0)).alias("dry"))
    for n, want in ((3, 1), (80, 10), (64 * cores * 8, cores * 8), (64 * 1000, 1000)):
        database.features(dealt(n), speech, S)
        assert [r[1:] for r in sizes[-1].collect()] == [(min(want, max(4 * cores, -(-n // 64))), 1)]


def test_strided_products_equal_windows():
    rng = np.random.default_rng(3)
    for size, width, step, count, at_once in ((1000, 70, 7, 130, 1 << 17), (1000, 70, 7, 130, 50), (50, 33, 40, 2, 1 << 17), (10, 4, 1, 7, 3), (9, 4, 5, 3, 1), (0, 3, 2, 2, 9), (5, 3, 2, 0, 9)):
        x, taps = rng.standard_normal(size), rng.standard_normal(width)
        padded = np.concatenate([x, np.zeros(count * step + width)])
        want = [padded[i * step :][:width] @ taps for i in range(count)]
        assert np.allclose(kernels.strided_products(x, taps, step, count, at_once), want, atol=1e-12)


def test_a_feature_copies_no_windows():
    x = np.random.default_rng(4).standard_normal(8000)
    kernels.temporal_envelope(x, 1600)
    tracemalloc.start()
    kernels.resampled(x, 1600, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 19


def test_rounds_that_come_again_are_not_made_again(monkeypatch):
    line, rounds = kernels.line, []
    monkeypatch.setattr(kernels, "line", lambda *xy: rounds.append(1) or line(*xy))
    most = []
    for k in range(8):
        x = kernels.with_noise(kernels.synthetic_response(0.4 + k / 10, 1600, k), 35.0, k)
        for band in (125, 250):
            own = kernels.band_passed(x, band, 1600)
            rounds.clear()
            got = kernels.decay_time(own, 1600, -10.0)
            most.append(len(rounds))
            assert np.isfinite(got).all()
    assert np.median(most) < 20


def test_filters_of_one_signal_share_its_spectra():
    x, spectra = np.random.default_rng(5).standard_normal(3000), {}
    for band in (16, 31, 63, 125, 250):
        assert (kernels.band_passed(x, band, 1600, spectra=spectra) == kernels.band_passed(x, band, 1600)).all()
    assert 1 <= len(spectra) < 5
