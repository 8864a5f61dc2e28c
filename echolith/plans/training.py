"""Training of the per-band networks over a record table, all bands in one job.

Records are dealt to shards by a hash of their keys, as many as the band's rows ask for, so that no band is one task's and neither the input's split nor its order plays a part. In an epoch each shard goes through its rows in mini-batches from the band's present parameters (Adam; dropout and the order of rows are drawn from seed, epoch, band and shard); the shards' parameters and moments are then averaged, weighted by rows, first in their task, then FOLD tasks at a time in a fixed order. The driver holds a few copies of the parameters of each band, some thousand numbers.

An epoch's state (parameters, moments, best parameters, patience of each band) is a table in the run's folder. A run that broke off goes on from the last whole state with the same history. A band whose validation loss hasn't fallen for patience epochs stops, its rows are no longer read, and its best parameters are the result.

Defined results: rows with a null key column are dealt like others; rows with a null band, feature or target, or a feature of another length, take no part; keys should be distinct (rows with equal keys share a shard and a side of the validation split). A band without validation rows is judged by its training loss. An empty table trains nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.operators import ranks, records
from echolith.plans import model
from echolith.schema import FEATURE_SIZE
from echolith.sources import tables

#: Parts folded together.
FOLD = 64
#: Shards of a task, about, at most.
SHARDS = 32


@dataclass(frozen=True)
class Training:
    """What a training depends on besides its records."""

    epochs: int = 500
    patience: int = 100
    batch: int = 1024
    validation: float = 0.1
    rate: float = 0.001
    dropout: float = 0.4
    momentum: float = 0.99
    seed: int = 2222
    #: Rows of a shard, about, and most rows of it that are shuffled and held at once.
    shard_rows: int = 8192
    #: Tasks that the rows are dealt to, more where one would get over SHARDS shards; part of the result's last digits, as sums are folded by task.
    tasks: int = 64


def sizes() -> dict[str, slice]:
    """Where each layer's weights are in the flat parameters."""
    out, at = {}, 0
    for name, shape in model.shapes(FEATURE_SIZE).items():
        out[name] = slice(at, at + int(np.prod(shape)))
        at = out[name].stop
    return out


_WHERE = sizes()
_COUNT = max(s.stop for s in _WHERE.values())
#: Which parameters follow the gradient; the others are running statistics.
_LEARNT = np.ones(_COUNT, bool)
for _name, _slice in _WHERE.items():
    if _name.endswith(("mean", "variance")):
        _LEARNT[_slice] = False


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in _WHERE])


def layers(p: np.ndarray) -> dict[str, np.ndarray]:
    return {name: p[_WHERE[name]].reshape(shape) for name, shape in model.shapes(FEATURE_SIZE).items()}


def _array(space: dict, name: str, *shape: int) -> np.ndarray:
    """An array that the next batch of this shape uses again, as large arrays cost more to get than to fill."""
    if name not in space or space[name].shape != shape:
        space[name] = np.empty(shape)
    return space[name]


def _windows(h: np.ndarray, size: int, space: dict, name: str) -> np.ndarray:
    """Each place's window of h (n, length, channels) as a row, so that a convolution is one product of matrices."""
    h = np.ascontiguousarray(h)
    n, length, channels = h.shape
    seen = np.lib.stride_tricks.as_strided(h, (n, length - size + 1, size * channels), (length * channels * h.itemsize, channels * h.itemsize, h.itemsize))
    out = _array(space, name, *seen.shape)
    np.copyto(out, seen)
    return out.reshape(-1, size * channels)


def gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray, keep: np.ndarray | None = None, space: dict | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, batch statistics in the places of the running ones) of a batch in training: the mean squared error, normalisation by the batch's own mean and variance. keep: the dropout's factors after the second layer. space: arrays that calls share."""
    space = {} if space is None else space
    w, g, seen = layers(p), layers(np.zeros(_COUNT)), layers(np.zeros(_COUNT))
    h, steps = x[:, :, None], []
    for i in range(len(model.FILTERS)):
        k = w[f"conv{i}/kernel"]
        size = h.shape[1] - len(k) + 1
        step = {"rows": _windows(h, len(k), space, f"rows{i}"), "size": size}
        z = np.matmul(step["rows"], k.reshape(-1, k.shape[2]), out=_array(space, f"z{i}", len(h) * size, k.shape[2]))
        z += w[f"conv{i}/bias"]
        h = z.reshape(len(h), size, -1)
        if i < len(model.POOLS):
            pool = model.POOLS[i]
            blocks = h[:, : size // pool * pool].reshape(len(h), -1, pool, h.shape[2])
            most = blocks[:, :, 0]
            for j in range(1, pool):
                most = np.maximum(most, blocks[:, :, j])
            step["blocks"], step["most"] = blocks, most
            h = np.maximum(most, 0)
            count = h.shape[0] * h.shape[1]
            mean = np.ones(count) @ h.reshape(count, -1) / count
            h = h - mean
            variance = np.einsum("nlc,nlc->c", h, h) / count
            step["scale"] = 1 / np.sqrt(variance + model.BATCH_EPSILON)
            h *= step["scale"]
            step["unit"] = h
            seen[f"norm{i}/mean"][:], seen[f"norm{i}/variance"][:] = mean, variance
            h = h * w[f"norm{i}/gamma"]
            h += w[f"norm{i}/beta"]
            if i == 1 and keep is not None:
                h *= keep
        else:
            step["on"] = h > 0
            h = np.maximum(h, 0)
        steps.append(step)
    last = h.reshape(len(h), -1)
    off = last @ w["dense/kernel"] + w["dense/bias"] - y
    d = 2 * off / off.size
    g["dense/kernel"][:], g["dense/bias"][:] = last.T @ d, d.sum(axis=0)
    d = (d @ w["dense/kernel"].T).reshape(h.shape)
    for i, step in reversed(list(enumerate(steps))):
        k = w[f"conv{i}/kernel"]
        room = len(k) - 1 if i else 0  # zeros around d for the way back, which ends at the first layer
        whole = _array(space, f"whole{i}", len(d), step["size"] + 2 * room, k.shape[2])
        whole[:] = 0
        inner = whole[:, room : room + step["size"]]
        if i < len(model.POOLS):
            if i == 1 and keep is not None:
                d = d * keep
            unit, count = step["unit"], d.shape[0] * d.shape[1]
            total, along = np.ones(count) @ d.reshape(count, -1), np.einsum("nlc,nlc->c", d, unit)
            g[f"norm{i}/gamma"][:], g[f"norm{i}/beta"][:] = along, total
            gamma = w[f"norm{i}/gamma"]
            d = d - total / count
            d -= unit * (along / count)
            d *= step["scale"] * gamma
            d *= step["most"] > 0
            blocks, free = step["blocks"], None
            for j in range(model.POOLS[i]):  # to the first of the largest
                here = blocks[:, :, j] == step["most"]
                if free is not None:
                    here &= free
                np.multiply(d, here, out=inner[:, j : d.shape[1] * model.POOLS[i] : model.POOLS[i]])
                free = ~here if free is None else free & ~here
        else:
            np.multiply(d, step["on"], out=inner)
        own = _array(space, f"own{i}", *inner.shape) if room else inner
        if room:
            np.copyto(own, inner)
        own = own.reshape(-1, k.shape[2])
        g[f"conv{i}/bias"][:] = np.ones(len(own)) @ own
        g[f"conv{i}/kernel"][:] = (step["rows"].T @ own).reshape(k.shape)
        if i:
            d = (_windows(whole, len(k), space, f"back{i}") @ k[::-1].transpose(0, 2, 1).reshape(-1, k.shape[1])).reshape(len(d), -1, k.shape[1])
    return float((off**2).mean()), flat(g), flat(seen)


@dataclass
class Adam:
    """Parameters with their moments and the number of steps taken."""

    p: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: float

    def move(self, g: np.ndarray, seen: np.ndarray, t: Training) -> None:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        by = t.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-7)
        self.p = np.where(_LEARNT, self.p - by, t.momentum * self.p + (1 - t.momentum) * seen)


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    matrix = lambda c, n: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
    return matrix("tae", FEATURE_SIZE), matrix("target", len(records.DESCRIPTORS))


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(band, shard, number, features, targets): each shard's rows in pieces of at most so many; rows come sorted by band and shard."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key, number, size = None, 0, 0

    def out():
        return (*key, number, np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    for b in batches:
        keys = np.column_stack([b.column("band").to_numpy(), b.column("shard").to_numpy()])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        for first, end in zip(cuts, cuts[1:]):
            if first == end:
                continue
            own = tuple(keys[first].tolist())
            if key is not None and own != key:
                if held:
                    yield out()
                held, number, size = [], 0, 0
            key = own
            while first < end:
                more = min(end - first, most - size)
                held.append(_arrays(b.slice(first, more)))
                first, size = first + more, size + more
                if size == most:
                    yield out()
                    held, number, size = [], number + 1, 0
    if held:
        yield out()


_PART = "band int, task int, rows double, loss double, step double, sums array<double>"


def _part(band: int, task: int, rows: float, loss: float, step: float, sums: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([band], pa.int32()), pa.array([task], pa.int32()), *(pa.array([v], pa.float64()) for v in (rows, loss, step)), pa.array([sums], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(values, ["band", "task", "rows", "loss", "step", "sums"])


def _trained(t: Training, epoch: int, at: dict[int, Adam]):
    """An epoch of each shard, summed up by band, weighted by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        state, last, done, space = None, None, [0.0, 0.0], {}

        def finished() -> None:
            band, rows = last[0], done[0]
            parts = total.setdefault(band, [0.0, 0.0, 0.0, np.zeros(3 * _COUNT)])
            parts[0] += rows
            parts[1] += done[1]
            parts[2] += rows * state.step
            parts[3] += rows * np.concatenate([state.p, state.first, state.second])

        for band, shard, number, x, y in _segments(batches, t.shard_rows):
            if last != (band, shard):
                if last is not None:
                    finished()
                start = at[band]
                state, last, done = Adam(start.p, start.first, start.second, start.step), (band, shard), [0.0, 0.0]
            rng = np.random.default_rng([t.seed, epoch, band, shard, number])
            order = rng.permutation(len(x))
            for first in range(0, len(x), t.batch):
                own = order[first : first + t.batch]
                size = ((FEATURE_SIZE - model.KERNELS[0] + 1) // model.POOLS[0] - model.KERNELS[1] + 1) // model.POOLS[1]
                keep = (rng.random((len(own), size, model.FILTERS[1])) >= t.dropout) / (1 - t.dropout)
                loss, g, seen = gradient(state.p, x[own], y[own], keep, space)
                state.move(g, seen, t)
                done[0] += len(own)
                done[1] += loss * len(own)
        if last is not None:
            finished()
        task = TaskContext.get().partitionId()
        for band, (rows, loss, step, sums) in sorted(total.items()):
            yield _part(band, task, rows, loss, step, sums)

    return run


def _judged(t: Training, at: dict[int, Adam]):
    """The loss over rows, by band, without dropout and by running statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[float]] = {}
        for band, _, _, x, y in _segments(batches, t.batch):
            own = total.setdefault(band, [0.0, 0.0])
            own[0] += len(x)
            own[1] += float(((model.forward(layers(at[band].p), x) - y) ** 2).mean(axis=1).sum())
        for band, (rows, loss) in sorted(total.items()):
            yield _part(band, TaskContext.get().partitionId(), rows, loss, 0.0, np.zeros(0))

    return run


def _summed(parts: DataFrame, tasks: int) -> dict[int, tuple[float, float, float, np.ndarray]]:
    """Parts summed by band, in the order of tasks: FOLD of them in a task until at most FOLD a band are left for the driver."""

    def add(group: pa.Table) -> pa.Table:
        rows = group.sort_by("task").to_pylist()
        first = rows[0]
        sums = np.sum([r["sums"] for r in rows], axis=0)
        return pa.Table.from_batches([_part(first["band"], first["task"] // FOLD, *(float(sum(r[c] for r in rows)) for c in ("rows", "loss", "step")), sums)])

    while tasks > FOLD:
        parts, tasks = parts.groupBy("band", F.floor(F.col("task") / FOLD)).applyInArrow(add, _PART), -(-tasks // FOLD)
    out: dict[int, tuple] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["band"], r["task"])):
        own = (r["rows"], r["loss"], r["step"], np.array(r["sums"], float))
        out[r["band"]] = tuple(a + b for a, b in zip(out[r["band"]], own)) if r["band"] in out else own
    return out


def dealt(rows: DataFrame, keys: list[str], t: Training) -> DataFrame:
    """(band, shard, validation, tae, target) from records (keys..., band, tae, descriptors as columns), dealt to tasks and sorted by band and shard. The records are written to a shared table first, as the split reads their keys several times."""
    return _dealt(rows, keys, t)[0]


def _dealt(rows: DataFrame, keys: list[str], t: Training) -> tuple[DataFrame, int]:
    """dealt() and its number of tasks, which grows with the rows. The driver gets a count of each band."""
    target = F.array(*(F.col(c).cast("double") for c in records.DESCRIPTORS))
    fits = F.col("band").isNotNull() & (F.size("tae") == FEATURE_SIZE) & ~F.exists("tae", lambda v: v.isNull() | F.isnan(v)) & ~F.exists(target, lambda v: v.isNull() | F.isnan(v))
    name = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    rows = rows.where(fits).select(F.col("band").cast("int").alias("band"), name.alias("key"), F.col("tae").cast("array<double>").alias("tae"), target.alias("target"))
    rows = tables.shared(rows, "training")
    counts = [(band, -(-n // t.shard_rows)) for band, n in rows.groupBy("band").count().collect()]
    tasks = max(t.tasks, -(-sum(n for _, n in counts) // SHARDS))
    rows = ranks.with_validation(rows, ["band"], F.col("key"), t.seed, t.validation)
    shard = F.pmod(F.xxhash64("key", F.lit(t.seed)), F.col("shards"))
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(counts, "band int, shards long")), "band").select("band", shard.alias("shard"), "validation", "tae", "target", F.xxhash64("key").alias("order"), "key")
    return rows.repartition(tasks, "band", "shard").sortWithinPartitions("band", "shard", "order", "key").drop("order", "key"), tasks


_STATE = "band int, epoch int, step double, loss double, val_loss double, best_loss double, best_epoch int, wait int, stopped boolean, settings string, p array<double>, first array<double>, second array<double>, best array<double>"
_HISTORY = ["band", "epoch", "loss", "val_loss"]


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs with a whole state, rising."""
    return sorted(int(n) for n in tables.folders(spark, f"{path}/state") if n.isdigit() and tables.exists(spark, f"{path}/state/{n}"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """(band, epoch, loss, val_loss) of a run: epochs count from 1."""
    done = _epochs(spark, path)
    found = [f"{path}/history/{n}" for n in tables.folders(spark, f"{path}/history") if n.isdigit() and done and int(n) <= done[-1]]
    return spark.read.parquet(*found).select(*_HISTORY) if found else spark.createDataFrame([], "band int, epoch int, loss double, val_loss double")


def weights(spark: SparkSession, path: str) -> DataFrame:
    """The best parameters of each band so far, as model.predict takes them."""
    done = _epochs(spark, path)
    found = spark.read.parquet(f"{path}/state/{done[-1]}").select("band", "best").collect() if done else []
    return model.weight_table(spark, {r["band"]: layers(np.array(r["best"])) for r in found}) if found else spark.createDataFrame([], model.WEIGHTS)


def train(rows: DataFrame, path: str, keys: list[str], t: Training = Training(), stop_after: int | None = None) -> None:
    """Trains the network of every band of rows (keys..., band, tae, normalised descriptors) and leaves weights() and history() in path. A run that is there goes on; stop_after: epochs of this call at most."""
    spark, settings = rows.sparkSession, json.dumps(asdict(t) | {"epochs": None}, sort_keys=True)
    done = _epochs(spark, path)
    data, tasks = _dealt(rows, keys, t)
    data = data.persist()
    try:
        if done:
            state = {r["band"]: r.asDict() for r in spark.read.parquet(f"{path}/state/{done[-1]}").collect()}
            if any(s["settings"] != settings for s in state.values()):
                raise ValueError("the run in this folder has other settings")
        else:
            bands = [r["band"] for r in data.select("band").distinct().collect()]
            start = {b: flat(model.initial_weights(t.seed + b)) for b in bands}
            blank = dict(epoch=0, step=0.0, loss=None, val_loss=None, best_loss=float("inf"), best_epoch=0, wait=0, stopped=False, settings=settings)
            state = {b: {"band": b, **blank, "p": p, "first": np.zeros(_COUNT), "second": np.zeros(_COUNT), "best": p} for b, p in start.items()}
        epoch, last = (done[-1] if done else 0), min(t.epochs, (done[-1] if done else 0) + (stop_after or t.epochs))
        while epoch < last and any(not s["stopped"] for s in state.values()):
            epoch += 1
            state = _advanced(data, state, epoch, t, tasks)
            spark.createDataFrame([tuple(s[c] for c in _HISTORY) for s in state.values() if s["epoch"] == epoch], "band int, epoch int, loss double, val_loss double").coalesce(1).write.mode("overwrite").parquet(f"{path}/history/{epoch}")
            columns = [c.split()[0] for c in _STATE.split(", ")]
            listed = [tuple(s[c].tolist() if isinstance(s[c], np.ndarray) else s[c] for c in columns) for s in state.values()]
            spark.createDataFrame(listed, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/{epoch}")
            tables.remove(spark, f"{path}/state/{epoch - 2}")  # the one before stays, should this one turn out broken
    finally:
        data.unpersist()


def _advanced(data: DataFrame, state: dict[int, dict], epoch: int, t: Training, tasks: int) -> dict[int, dict]:
    """The state after one more epoch of the bands that go on."""
    at = {b: Adam(np.array(s["p"]), np.array(s["first"]), np.array(s["second"]), s["step"]) for b, s in state.items() if not s["stopped"]}
    rows = data.where(F.col("band").isin(list(at))).select("band", "shard", "validation", "tae", "target")
    trained = _summed(rows.where(~F.col("validation")).mapInArrow(_trained(t, epoch, at), _PART), tasks)
    for band, (n, _, step, sums) in trained.items():
        at[band] = Adam(*np.split(sums / n, 3), step / n)
    judged = _summed(rows.where("validation").mapInArrow(_judged(t, at), _PART), tasks)
    out = dict(state)
    for band, own in at.items():
        loss = trained[band][1] / trained[band][0] if band in trained else None
        val = judged[band][1] / judged[band][0] if band in judged else loss
        s = state[band] | {"epoch": epoch, "step": own.step, "loss": loss, "val_loss": val, "p": own.p, "first": own.first, "second": own.second}
        if val is not None and val < s["best_loss"]:
            s |= {"best_loss": val, "best_epoch": epoch, "wait": 0, "best": own.p}
        else:
            s["wait"] += 1
        s["stopped"] = s["wait"] >= t.patience
        out[band] = s
    return out


def experiment(found: DataFrame, path: str, keys: list[str], t: Training = Training(), digits: int = 2) -> None:
    """A whole experiment on a record table (keys..., band, type_data, tae, descriptors as columns): percentiles over all records, training of every band on the train split, rounded predictions and errors on the test split. path then holds run (weights and history), norms and results, a partition a band; a call that broke off goes on."""
    spark = found.sparkSession
    if not tables.exists(spark, f"{path}/norms"):
        ranks.column_percentiles(found, ["band"], records.DESCRIPTORS, 0.95, "_p95").write.mode("overwrite").parquet(f"{path}/norms")
    norms = spark.read.parquet(f"{path}/norms")
    scaled = found.join(F.broadcast(norms), "band").select(*keys, "type_data", "tae", *([] if "band" in keys else ["band"]), *((F.col(c) / F.nullif(F.col(f"{c}_p95"), F.lit(0.0))).alias(c) for c in records.DESCRIPTORS))
    train(scaled.where("type_data = 'train'"), f"{path}/run", keys, t)
    test, by = scaled.where("type_data = 'test'"), keys if "band" in keys else [*keys, "band"]
    predicted = model.predict(test, weights(spark, f"{path}/run"), by, digits)
    tables.write_results(records.results(predicted, test, by), f"{path}/results")
