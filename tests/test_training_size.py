"""Training at size: tasks grow with the rows, batches share arrays."""

import numpy as np
import pytest
from test_training import plain, some, table

from echolith.plans import model, training
from echolith.plans.training import Training


def test_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "SHARDS", 2)
    df, t = table(spark), Training(epochs=2, batch=8, shard_rows=10, tasks=3, rate=0.01)
    data, tasks = training._dealt(df, ["name"], t)
    assert tasks == 12 == data.rdd.getNumPartitions() and data.count() == 240  # 12 shards in each of two bands
    assert training._dealt(df, ["name"], Training(shard_rows=1000, tasks=3))[1] == 3
    assert training._dealt(df.where("false"), ["name"], t)[1] == 3
    training.train(df, str(tmp_path / "run"), ["name"], t)
    got = {(r["band"], r["epoch"]): (r["loss"], r["val_loss"]) for r in training.history(spark, str(tmp_path / "run")).collect()}
    want = plain(df, ["name"], t, 2)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)


def test_batches_of_any_size_share_arrays():
    space, p = {}, training.flat(model.initial_weights(1))
    for n in (8, 3, 8, 1):
        x, y = some(n, n)
        keep = (np.random.default_rng(n).random((n, 45, 18)) >= 0.4) / 0.6
        alone, shared = training.gradient(p, x, y, keep), training.gradient(p, x, y, keep, space)
        assert alone[0] == shared[0] and (alone[1] == shared[1]).all() and (alone[2] == shared[2]).all()
