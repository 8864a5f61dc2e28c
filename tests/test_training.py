"""Training: gradients by finite differences, losses that fall, runs that go on, bands that stop."""

import numpy as np
import pytest

from echolith.plans import model, training
from echolith.plans.training import Adam, Training


def some(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.abs(rng.standard_normal((n, 200))), rng.standard_normal((n, 4))


def table(spark, n=120, bands=(125, 500), seed=0):
    x, _ = some(n, seed)
    y = np.column_stack([x.mean(axis=1), x[:, :50].mean(axis=1), x[:, 50:].max(axis=1) / 3, x[:, 0]])
    rows = [(f"r{i}", b, "test" if i % 5 == 0 else "train", x[i].tolist(), *(y[i] * (1 + b / 1000)).tolist()) for i in range(n) for b in bands]
    return spark.createDataFrame(rows, "name string, band int, type_data string, tae array<double>, t30 double, c50 double, c80 double, d50 double")


def test_every_layers_gradient_by_finite_differences():
    x, y = some(6)
    rng = np.random.default_rng(3)
    p = training.flat(model.initial_weights(1)) + 0.05 * rng.standard_normal(training._COUNT)
    keep = (rng.random((6, 45, 18)) >= 0.4) / 0.6
    _, g, seen = training.gradient(p, x, y, keep)
    for name, where in training._WHERE.items():
        if name.endswith(("mean", "variance")):
            assert not g[where].any() and seen[where].any()
            continue
        assert not seen[where].any()
        for k in rng.choice(np.arange(where.start, where.stop), min(6, where.stop - where.start), replace=False):
            step = np.zeros(len(p))
            step[k] = 1e-6
            slope = (training.gradient(p + step, x, y, keep)[0] - training.gradient(p - step, x, y, keep)[0]) / 2e-6
            assert g[k] == pytest.approx(slope, rel=1e-4, abs=1e-7), (name, k)


def test_batch_statistics_make_training_and_prediction_agree():
    x, y = some(40)
    p = training.flat(model.initial_weights(1))
    loss, _, seen = training.gradient(p, x, y)
    p = np.where(training._LEARNT, p, seen)
    assert ((model.forward(training.layers(p), x) - y) ** 2).mean() == pytest.approx(loss)


def test_adam_moves_by_the_rate_at_first():
    g = np.random.default_rng(0).standard_normal(training._COUNT)
    a = Adam(np.zeros(training._COUNT), np.zeros(training._COUNT), np.zeros(training._COUNT), 0.0)
    a.move(g, np.ones(training._COUNT), Training(rate=0.01))
    assert np.allclose(a.p[training._LEARNT], -0.01 * np.sign(g[training._LEARNT]), rtol=1e-3) and np.allclose(a.p[~training._LEARNT], 0.01)


def plain(df, keys, t, epochs):
    """Histories of the same training on one machine: shards one after the other, averaged by rows."""
    rows = [r.asDict() for r in training.dealt(df, keys, t).collect()]
    out = {}
    for band in sorted({r["band"] for r in rows}):
        own = [r for r in rows if r["band"] == band]
        state = Adam(training.flat(model.initial_weights(t.seed + band)), *np.zeros((2, training._COUNT)), 0.0)
        for epoch in range(1, epochs + 1):
            parts, losses = [], []
            for shard in sorted({r["shard"] for r in own}):
                mine = [r for r in own if r["shard"] == shard and not r["validation"]]
                if not mine:
                    continue
                a, x, y = Adam(state.p, state.first, state.second, state.step), np.array([r["tae"] for r in mine]), np.array([r["target"] for r in mine])
                for number, first in enumerate(range(0, len(x), t.shard_rows)):
                    sx, sy = x[first : first + t.shard_rows], y[first : first + t.shard_rows]
                    rng = np.random.default_rng([t.seed, epoch, band, shard, number])
                    order = rng.permutation(len(sx))
                    for at in range(0, len(sx), t.batch):
                        k = order[at : at + t.batch]
                        loss, g, seen = training.gradient(a.p, sx[k], sy[k], (rng.random((len(k), 45, 18)) >= t.dropout) / (1 - t.dropout))
                        a.move(g, seen, t)
                        losses += [loss] * len(k)
                parts.append((len(mine), a))
            n = sum(k for k, _ in parts)
            mean = lambda f: sum(k * f(a) for k, a in parts) / n
            state = Adam(mean(lambda a: a.p), mean(lambda a: a.first), mean(lambda a: a.second), mean(lambda a: a.step))
            val = [r for r in own if r["validation"]]
            off = model.forward(training.layers(state.p), np.array([r["tae"] for r in val])) - np.array([r["target"] for r in val])
            out[band, epoch] = (np.mean(losses), (off**2).mean())
    return out


def test_training_is_what_it_says_whatever_the_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "FOLD", 2)  # parts are folded in tasks too
    df = table(spark)
    t = Training(epochs=3, batch=8, shard_rows=30, tasks=5, rate=0.01)
    training.train(df.repartition(1), str(tmp_path / "a"), ["name"], t)
    training.train(df.repartition(7, "t30"), str(tmp_path / "b"), ["name"], t)
    a, b = ({(r["band"], r["epoch"]): (r["loss"], r["val_loss"]) for r in training.history(spark, str(tmp_path / k)).collect()} for k in "ab")
    assert a == b and len(a) == 6
    want = plain(df, ["name"], t, 3)
    assert a.keys() == want.keys() and all(a[k] == pytest.approx(want[k], rel=1e-9) for k in a)
    for band in (125, 500):
        assert a[band, 3][0] < a[band, 1][0]


def test_a_broken_run_goes_on_with_the_same_history(spark, tmp_path):
    from echolith.sources import tables

    df, t = table(spark, 60), Training(epochs=4, batch=16, shard_rows=20, tasks=3, rate=0.01)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    training.train(df, whole, ["name"], t)
    training.train(df, broken, ["name"], t, stop_after=2)
    spark.range(3).write.parquet(f"{broken}/history/3")  # the driver died between an epoch's two tables
    (tmp_path / "broken" / "state" / "3").mkdir()
    assert training.history(spark, broken).count() == 4 and not tables.exists(spark, f"{broken}/state/3")
    training.train(df, broken, ["name"], t)
    rows = lambda p: sorted(tuple(r) for r in training.history(spark, p).collect())
    assert rows(whole) == rows(broken) and len(rows(whole)) == 8
    same = lambda p: sorted((r["band"], r["layer"], tuple(r["values"])) for r in training.weights(spark, p).collect())
    assert same(whole) == same(broken)
    with pytest.raises(ValueError):
        training.train(df, broken, ["name"], Training(epochs=5, rate=0.5))


def test_bands_stop_one_by_one_and_keep_their_best(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    df, path = table(spark, 60), str(tmp_path / "run")
    losses = {125: [3.0, 2.0, 2.5, 2.0, 9.0, 9.0], 500: [5.0, 4.0, 3.0, 2.0, 1.0, 0.5]}
    judged = training._summed

    def scripted(parts, tasks):
        out = judged(parts, tasks)
        if not all(len(v[3]) for v in out.values()):  # validation losses as scripted
            scripted.epoch += 1
            out = {b: (1.0, losses[b][scripted.epoch - 1], 0.0, v[3]) for b, v in out.items()}
        return out

    scripted.epoch = 0
    monkeypatch.setattr(training, "_summed", scripted)
    training.train(df, path, ["name"], Training(epochs=6, patience=2, batch=32, tasks=2))
    got = training.history(spark, path)
    assert {r["band"]: r["n"] for r in got.groupBy("band").agg(F.count("*").alias("n")).collect()} == {125: 4, 500: 6}
    from echolith.operators.records import best_epoch

    assert {r["band"]: (r["best_epoch"], r["best_loss"], r["epochs"]) for r in best_epoch(got, ["band"]).collect()} == {125: (2, 2.0, 4), 500: (6, 0.5, 6)}
    state = {r["band"]: r for r in spark.read.parquet(f"{path}/state/6").collect()}
    assert state[125]["stopped"] and state[125]["best_epoch"] == 2 and state[125]["best"] != state[125]["p"] and state[500]["best"] == state[500]["p"]


def test_an_experiment_leaves_weights_history_norms_and_results(spark, tmp_path):
    from echolith.sources import tables

    df = table(spark, 60)
    odd = spark.createDataFrame([("x", 125, "train", None, 1.0, 1.0, 1.0, 1.0), ("y", 125, "train", [1.0], 1.0, 1.0, 1.0, 1.0), ("z", 125, "train", [0.5] * 200, None, 1.0, 1.0, 1.0)], df.schema)
    path = str(tmp_path / "exp")
    training.experiment(df.unionByName(odd), path, ["name"], Training(epochs=2, batch=16, tasks=2))
    assert spark.read.parquet(f"{path}/norms").count() == 2
    got = tables.read_results(spark, path + "/results")
    assert got.count() == 24 and {"predicted_t30", "true_d50", "err_c80"} <= set(got.columns)
    assert training.history(spark, f"{path}/run").count() == 4
    training.experiment(df.where("false"), str(tmp_path / "none"), ["name"], Training(epochs=2))
    assert training.history(spark, str(tmp_path / "none") + "/run").count() == 0
