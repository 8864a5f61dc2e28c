"""The per-band network that estimates descriptors from the envelope feature: its forward pass over record tables.

Four convolutions with max-pooling and batch normalisation after the first three, and a dense layer of four outputs. Weights are a table (band, layer, shape, values), so that one scan predicts every band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.functions.arrays import half_even
from echolith.operators.records import DESCRIPTORS, with_measured
from echolith.plans import database

#: Filters, kernel sizes and pool sizes: fixed values of the experiments.
FILTERS, KERNELS, POOLS = (32, 18, 8, 4), (10, 5, 5, 5), (2, 2, 2)
BATCH_EPSILON = 1e-3
#: Records that go through a network together: its layers are many times wider than a feature.
TOGETHER = 256
WEIGHTS = "band int, layer string, shape array<int>, values array<double>"


def shapes(size: int = 200) -> dict[str, tuple[int, ...]]:
    """The shape of each weight, by layer."""
    out, channels = {}, 1
    for i, (f, k) in enumerate(zip(FILTERS, KERNELS)):
        out |= {f"conv{i}/kernel": (k, channels, f), f"conv{i}/bias": (f,)}
        size, channels = size - k + 1, f
        if i < len(POOLS):
            out |= {f"norm{i}/{part}": (f,) for part in ("gamma", "beta", "mean", "variance")}
            size //= POOLS[i]
    return out | {"dense/kernel": (size * channels, 4), "dense/bias": (4,)}


def initial_weights(seed: int) -> dict[str, np.ndarray]:
    """Glorot-uniform kernels, zero biases, identity normalisation."""
    rng, out = np.random.default_rng(seed), {}
    for name, shape in shapes().items():
        if name.endswith("kernel"):
            fan = np.prod(shape[:-1]) + np.prod(shape[:-2], initial=1.0) * shape[-1]
            out[name] = rng.uniform(-1, 1, shape) * np.sqrt(6 / fan)
        else:
            out[name] = np.ones(shape) if name.endswith(("gamma", "variance")) else np.zeros(shape)
    return out


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Outputs (n, 4) of features (n, 200)."""
    h = x[:, :, None]
    for i in range(len(FILTERS)):
        k = w[f"conv{i}/kernel"]
        h = np.einsum("nlck,kcf->nlf", np.lib.stride_tricks.sliding_window_view(h, len(k), axis=1), k, optimize=True) + w[f"conv{i}/bias"]
        h = np.maximum(h, 0)
        if i < len(POOLS):
            p = POOLS[i]
            h = h[:, : h.shape[1] // p * p].reshape(len(h), -1, p, h.shape[2]).max(axis=2)
            h = (h - w[f"norm{i}/mean"]) / np.sqrt(w[f"norm{i}/variance"] + BATCH_EPSILON) * w[f"norm{i}/gamma"] + w[f"norm{i}/beta"]
    return h.reshape(len(h), -1) @ w["dense/kernel"] + w["dense/bias"]


def weight_table(spark, by_band: dict[int, dict[str, np.ndarray]]) -> DataFrame:
    rows = [(b, k, list(v.shape), v.ravel().tolist()) for b, w in by_band.items() for k, v in w.items()]
    return spark.createDataFrame(rows, WEIGHTS)


def _predicted(by_band: dict[int, dict[str, np.ndarray]], keys: list[str]):
    """The outputs for each record beside its keys, TOGETHER records of a band at a time whatever the batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for band, own in df.groupby("band"):
                for first in range(0, len(own), TOGETHER):
                    part = own.iloc[first : first + TOGETHER]
                    out = forward(by_band[band], np.stack(part["tae"].to_numpy()))
                    yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(out, columns=list(DESCRIPTORS))], axis=1)

    return run


def predict(records: DataFrame, weights: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """(keys..., t30, c50, c80, d50): the rounded outputs for each record (keys, band, tae). keys must hold band. Weights are a few thousand numbers a band, collected once; a band without weights is left out."""
    by_band: dict[int, dict[str, np.ndarray]] = {}
    for r in weights.collect():
        by_band.setdefault(r["band"], {})[r["layer"]] = np.array(r["values"]).reshape(r["shape"])

    rows = records.where(F.col("band").isin(*by_band) & F.col("tae").isNotNull()).select(*keys, "tae")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "tae") + "".join(f", {c} double" for c in DESCRIPTORS)
    out = rows.mapInPandas(_predicted(by_band, keys), schema)
    return out.select(*keys, *(half_even(F.col(c), digits).alias(c) for c in DESCRIPTORS))


def estimates(signals: DataFrame, weights: DataFrame, scales: DataFrame, s: database.Settings = database.Settings()) -> DataFrame:
    """(name, band, t30, c50, c80, d50) estimated from reverberant signals (name, x) alone: features per band, the band's network, its percentiles. Bands that can't be featured are left out."""
    rows = database.band_features(signals, s).where("error is null")
    return denormalised(predict(rows, weights, ["name", "band"]), scales)


def room_estimates(signals: DataFrame, weights: DataFrame, scales: DataFrame, measured: DataFrame, s: database.Settings = database.Settings()) -> DataFrame:
    """Estimates beside a room's measured descriptors (name, band, ...), kind telling them apart, sorted by band and name."""
    return with_measured(estimates(signals, weights, scales, s).withColumn("kind", F.lit("estimated")), measured.withColumn("kind", F.lit("measured")))


def denormalised(predicted: DataFrame, scales: DataFrame, digits: int = 3) -> DataFrame:
    """Predictions times their band's percentiles (band, t30_p95, ...), a row per band."""
    joined = predicted.join(scales, "band")
    return joined.select(*[c for c in predicted.columns if c not in DESCRIPTORS], *(half_even(F.col(c) * F.col(f"{c}_p95"), digits).alias(c) for c in DESCRIPTORS))
