"""Operators on tables that the given ones don't show: long signals in blocks, null groups, shared and repeated names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.functions import kernels
from echolith.operators import ranks, records, samples, splits

EVENTS = "user long, at double, id long, v double"


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(4)
    made = {1: rng.standard_normal(1000), 2: rng.standard_normal(7), 3: np.array([2.5]), 4: np.exp(-np.arange(300) / 40) * rng.standard_normal(300)}
    rows = [(name, float(i // 3) ** 1.5, i, float(v)) for name, x in made.items() for i, v in enumerate(x)]
    return made, spark.createDataFrame(rows, EVENTS).repartition(5)


@pytest.fixture(params=[1 << 16, 64, 5])
def block(request, monkeypatch):
    monkeypatch.setattr(samples, "BLOCK", request.param)
    return request.param


def by_name(df, column):
    out = {}
    for r in df.orderBy("name", "n").collect():
        out.setdefault(r["name"], []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


def test_series_in_blocks_equal_series_as_a_whole(signals, block):
    made, events = signals
    rows = samples.from_series(events, "user", ["at", "id"], "v")
    got = by_name(rows, "v")
    assert got.keys() == made.keys() and all(np.array_equal(got[k], made[k]) for k in made)
    assert by_name(rows, "n")[1].tolist() == list(range(1000))
    energy = by_name(samples.backward_energy(rows), "energy")
    curve = by_name(samples.decay_curve(rows), "db")
    for k, x in made.items():
        want = np.cumsum((x * x)[::-1])[::-1]
        assert np.allclose(energy[k], want) and np.allclose(curve[k], 10 * np.log10(want / want[0] + kernels.EPSILON))
    bounds = rows.groupBy("name").agg(F.ceil(F.count("*") / 2).alias("stop"), F.lit(0.5).alias("beyond"))
    share = by_name(samples.compensated_energy(rows, bounds), "share")
    for k, x in made.items():
        stop = -(-len(x) // 2)
        assert np.allclose(share[k], kernels.backward_energy(x * x, stop, 0.5))
    floor = {r["name"]: r["noise_db"] for r in samples.noise_floor(rows).collect()}
    x = made[1]
    assert floor[1] == pytest.approx(10 * np.log10((x[900:] ** 2).sum() / 100 / (x * x).max()))


@pytest.mark.parametrize("width", [1, 4, 13, 200])
def test_moving_windows_reach_over_blocks(signals, block, width):
    made, events = signals
    rows = samples.from_series(events, "user", ["at", "id"], "v")
    mean, peak, median = by_name(samples.moving_mean(rows, width), "mean"), by_name(samples.moving_max(rows, width), "peak"), by_name(samples.moving_median(rows, width), "median")
    before, after = width // 2, width - width // 2 - 1
    for k, x in made.items():
        x, n = np.abs(x), len(x)
        around = [x[max(i - before, 0) : i + after + 1] for i in range(n)]
        assert np.allclose(mean[k], [a.sum() / width for a in around]) and np.array_equal(peak[k], [a.max() for a in around])
        padded = np.concatenate([np.full(before, x[0]), x, np.full(after, x[-1])])
        assert np.array_equal(median[k], [sorted(padded[i : i + width])[before] for i in range(n)])


def test_a_long_signal_is_many_tasks_work(spark, monkeypatch):
    """Half a million samples of one signal: no window or join partition holds more than some blocks, and the rows are right."""
    monkeypatch.setattr(samples, "BLOCK", 1 << 14)
    n = 500_000
    x = spark.range(n, numPartitions=4).select(F.lit("a").alias("name"), F.col("id").alias("n"), F.cos(F.col("id") * 0.01).alias("v"))
    plan = samples.backward_energy(x)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(name") == plan.count("hashpartitioning(name#") and "block" in plan
    spread = samples._with_later(x).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < n
    v = np.cos(np.arange(n) * 0.01)
    got = by_name(samples.backward_energy(x).where("n % 9973 = 0"), "energy")["a"]
    assert np.allclose(got, np.cumsum((v * v)[::-1])[::-1][::9973])
    median = samples.moving_median(x, 500).where("n % 9973 = 0").orderBy("n").toPandas()["median"]
    padded = np.concatenate([np.full(250, abs(v[0])), np.abs(v), np.full(249, abs(v[-1]))])
    assert np.array_equal(median, [np.sort(padded[i : i + 500])[250] for i in range(0, n, 9973)])


def test_order_in_windows_takes_ties_and_odd_values():
    rng = np.random.default_rng(0)
    for x in (rng.integers(0, 3, 50).astype(float), np.zeros(20), rng.standard_normal(64), np.array([np.inf, 1.0, -np.inf, 1.0]), np.array([5.0])):
        for width in {1, 2, 3, len(x)} & set(range(1, len(x) + 1)):
            for k in {0, width // 2, width - 1}:
                assert kernels.window_order(x, width, k).tolist() == [sorted(x[i : i + width])[k] for i in range(len(x) - width + 1)]


def test_null_groups_are_groups(spark):
    rows = [(None, float(i), i % 7 * 1.0) for i in range(40)] + [("a", float(-i), i % 5 * 1.0) for i in range(30)] + [("a", None, 1.0), (None, None, None)]
    df = spark.createDataFrame([(*r, f"f{i}") for i, r in enumerate(rows)], "band string, x double, y double, name string")
    got = {r["band"]: r["p"] for r in ranks.percentiles(df, ["band"], "x", {"p": 0.95}).collect()}
    assert got == {None: pytest.approx(np.percentile(np.arange(40), 95)), "a": pytest.approx(np.percentile(-np.arange(30.0), 95))}
    assert {r["band"]: r["rows"] for r in records.spearman(df, ["band"], "x", "y").collect()} == {None: 40, "a": 30}
    assert records.normalised(df.withColumnsRenamed({"x": "t30"}), ("t30",)).count() == 72
    summary = {r["band"]: r for r in records.band_summary(df, ("x",)).collect()}
    assert summary[None]["rows"] == 41 and summary[None]["x_p95"] == 37.05 and summary["a"]["x_min"] == -29
    assert splits.pick(df, ["band"], "name", 1, count=3).groupBy("band").count().count() == 2
    assert ranks.sample(df, ["band"], F.col("name"), 1, 0.5).count() == 20 + 16
    assert records.box_plot(df, "x").count() == 2


def test_names_that_groups_share_are_drawn_in_each(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4), ("b", "z", 5), ("b", "z", 6), (None, "x", 7), (None, "q", 8), ("c", None, 9)], "room string, name string, id int")
    got = splits.with_split(df, ["room"], "name", 3)
    assert sorted(r["id"] for r in got.collect()) == list(range(1, 10))
    sides = got.groupBy("room", "name").agg(F.countDistinct("split").alias("n")).collect()
    assert all(r["n"] == 1 for r in sides)
    for r in got.groupBy("room").agg(F.count("*").alias("n"), F.count(F.when(F.col("split") == "train", 1)).alias("train")).collect():
        assert r["train"] <= int(r["n"] * 0.8)
    many = spark.range(1000).select((F.col("id") % 3).alias("room"), F.concat(F.lit("f"), F.floor(F.col("id") / 3)).alias("name"))
    counts = {(r["room"], r["split"]): r["count"] for r in splits.with_split(many, ["room"], "name", 9).groupBy("room", "split").count().collect()}
    assert counts == {(0, "train"): 267, (0, "test"): 67, (1, "train"): 266, (1, "test"): 67, (2, "train"): 266, (2, "test"): 67}


def test_pairs_within_a_split_do_not_depend_on_the_tables_split(spark):
    a = spark.createDataFrame([(f"r{i}", "train" if i % 2 else "test", [1.0]) for i in range(20)], "rir string, split string, x array<double>")
    b = spark.createDataFrame([(f"s{i}", "train" if i % 3 else "test") for i in range(9)], "speech string, split string")
    got = {n: sorted((r["rir"], r["speech"]) for r in splits.within_split(a.repartition(n), b).collect()) for n in (1, 5)}
    assert got[1] == got[5] and len(got[1]) == 10 * 6 + 10 * 3


def test_partners_are_counted_without_making_pairs(spark):
    """The counts of the pairs themselves, with repeated and null keys; the plan has no join of rows."""
    a = spark.createDataFrame([(i % 7 or None, "train" if i % 2 else "test") for i in range(40)] + [(1, "spare")], "rir int, split string")
    b = spark.createDataFrame([(i if i % 4 else None, "train" if i % 3 else "test") for i in range(30)] + [(5, "other")], "speech int, split string")
    got = splits.partners(a, b, "rir", "speech")
    want = splits.within_split(a, b).groupBy("split", "rir").agg(F.count("*").alias("pairs"), F.min("speech").alias("first_speech"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    many = splits.partners(spark.range(300_000).select("id", F.lit("train").alias("split")), spark.range(300_000).select(F.col("id").alias("speech"), F.lit("train").alias("split")), "id", "speech")
    assert many.agg(F.sum("pairs")).first()[0] == 300_000**2


def test_a_side_that_does_not_vary_has_no_correlation(spark):
    """NaN, as SQL gives it, and no division by zero; other groups keep theirs."""
    rows = [("flat", 1.0, float(i)) for i in range(9)] + [("up", float(i), float(i * i)) for i in range(9)] + [("down", float(i), -float(i)) for i in range(9)] + [("one", 2.0, 3.0)]
    out = {r["band"]: r for r in records.with_p_value(records.spearman(spark.createDataFrame(rows, "band string, x double, y double"), ["band"], "x", "y")).collect()}
    assert all(np.isnan(out[k]["rho"]) and np.isnan(out[k]["p"]) for k in ("flat", "one"))
    assert out["up"]["rho"] == pytest.approx(1) and out["down"]["rho"] == pytest.approx(-1) and out["up"]["p"] == pytest.approx(0, abs=1e-12)
