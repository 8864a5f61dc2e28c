"""Signals as rows of samples (name, n, v): windows and aggregates per signal, of any length.

A signal is cut into blocks of BLOCK samples, and each block is one window partition, so that a signal of any length is spread over many tasks. Running sums take the blocks' sums first, add these up along the signal (one row a block), and go on within each block from there. Moving windows get the samples that reach into a block from its neighbours as copies. Samples of a signal are numbered from 0 without gaps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import kernels
from echolith.functions.arrays import EPSILON

#: Kinds of reverberation time: (level where it starts, where it ends, factor to 60 dB): fixed values.
DECAYS = {"t30": (-5, -35, 2), "t20": (-5, -25, 3), "t10": (-5, -15, 6), "edt": (0, -10, 6)}


#: Samples of a block.
BLOCK = 1 << 16


def from_series(df: DataFrame, name: str, order: list[str], value: str) -> DataFrame:
    """(name, n, v) from a table of readings: n counts from 0 in the given order. A series of more than BLOCK readings is numbered in slices of equal width of the first order column (a number or a time), which only balance the work."""
    at = F.col(order[0])
    if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")):
        at = at.cast("timestamp")
    rows = df.select(F.col(name).alias("name"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), at.cast("double").alias("at"), F.col(value).cast("double").alias("v"))
    ranges = rows.groupBy(F.col("name").alias("of")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.ceil(F.count("*") / BLOCK).alias("slices"))
    part = (F.col("at") - F.col("first")) / F.nullif(F.col("last") - F.col("first"), F.lit(0.0)) * F.col("slices")
    rows = rows.join(ranges, F.col("name").eqNullSafe(F.col("of"))).select("name", *(f"o{i}" for i in range(len(order))), "v", F.coalesce(F.floor(part), F.lit(-1)).alias("slice"))
    key = F.struct("name", "slice").alias("key")  # null names are a series too
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    before = Window.partitionBy("key.name").orderBy("key.slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("key").orderBy(*(f"o{i}" for i in range(len(order))))
    placed = rows.select(key, *(f"o{i}" for i in range(len(order))), "v").join(starts, "key")
    return placed.select("key.name", (F.col("start") + F.row_number().over(own) - 1).alias("n"), "v")


def from_arrays(df: DataFrame, name: str, x: str) -> DataFrame:
    """(name, n, v) from a table of arrays."""
    return df.select(F.col(name).alias("name"), F.posexplode(x).alias("n", "v")).withColumn("v", F.col("v").cast("double"))


def _block() -> Column:
    return F.floor(F.col("n") / BLOCK)


def _with_later(samples: DataFrame) -> DataFrame:
    """samples with block, energy (what is left within the block from each sample on), later (the energy of the blocks after it) and whole (the signal's)."""
    rows = samples.withColumn("block", _block())
    sums = rows.groupBy("name", "block").agg(F.sum(F.col("v") * F.col("v")).alias("sum"))
    after = Window.partitionBy("name").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("name", "block", F.coalesce(F.sum("sum").over(after), F.lit(0.0)).alias("later"), F.sum("sum").over(Window.partitionBy("name")).alias("whole"))
    inside = Window.partitionBy("name", "block").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, ["name", "block"]).withColumn("energy", F.sum(F.col("v") * F.col("v")).over(inside))


def backward_energy(samples: DataFrame) -> DataFrame:
    """(name, n, energy): what is left of the signal's energy from each sample on."""
    return _with_later(samples).select("name", "n", (F.col("energy") + F.col("later")).alias("energy"))


def compensated_energy(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """(name, n, share): what is left of the signal's energy from each sample up to stop, and of the decay beyond it, as a share of all. bounds: (name, stop, beyond), a row a signal."""
    own = samples.join(bounds.select("name", "stop"), "name").where("n < stop").drop("stop")
    beyond = _with_later(own).join(bounds.select("name", "beyond"), "name")
    return beyond.select("name", "n", ((F.col("energy") + F.col("later") + F.col("beyond")) / F.nullif(F.col("whole") + F.col("beyond"), F.lit(0.0))).alias("share"))


def decay_curve(samples: DataFrame) -> DataFrame:
    """(name, n, db): the backward energy against all of it."""
    return _with_later(samples).select("name", "n", (10 * F.log10((F.col("energy") + F.col("later")) / F.col("whole") + EPSILON)).alias("db"))


def reverberation_time(samples: DataFrame, kind: str, fs: float) -> DataFrame:
    """(name, rt): the reverberation time by the slope of the decay curve between the samples nearest to two levels. Null where the slope is not defined."""
    if kind not in DECAYS:
        raise ValueError(f"no such reverberation time: {kind}")
    start, stop, factor = DECAYS[kind]
    curve = decay_curve(samples)
    limits = curve.groupBy("name").agg(*(F.min_by("n", F.struct(F.abs(F.col("db") - level), F.col("n"))).alias(k) for k, level in (("first", start), ("last", stop))))
    inside = curve.join(limits, "name").where("n between first and last")
    fit = inside.groupBy("name").agg(F.regr_slope("db", F.col("n") / fs).alias("m"))
    return fit.select("name", (factor * F.lit(float(stop - start)) / F.nullif("m", F.lit(0.0))).alias("rt"))


def block_means(samples: DataFrame, size: int) -> DataFrame:
    """(name, block, mean_energy) of consecutive blocks of size samples, an unfinished last one left out."""
    blocks = samples.groupBy("name", F.floor(F.col("n") / size).alias("block")).agg(F.avg(F.col("v") * F.col("v")).alias("mean_energy"), F.count("*").alias("size"))
    return blocks.where(F.col("size") == size).drop("size")


def noise_floor(samples: DataFrame) -> DataFrame:
    """(name, noise_db): energy of the last tenth against the largest, in dB; the tenth starts at 0.9 n, rounded half to even."""
    sized = samples.join(samples.groupBy("name").agg(F.count("*").alias("size")), "name")
    tail = F.sum(F.when(F.col("n") >= F.rint(0.9 * F.col("size")), F.col("v") * F.col("v")).otherwise(0.0))
    out = sized.groupBy("name", "size").agg(tail.alias("tail"), F.max(F.col("v") * F.col("v")).alias("top"))
    return out.select("name", (10 * F.log10(F.col("tail") / (0.1 * F.col("size")) / F.nullif("top", F.lit(0.0)) + EPSILON)).alias("noise_db"))


def _with_neighbours(samples: DataFrame, before: int, after: int) -> DataFrame:
    """Every sample in its block, and copies of it (own false) in the blocks whose windows reach it: before samples back and after ahead."""
    first, last = F.greatest(F.floor((F.col("n") - after) / BLOCK), F.lit(0)), F.floor((F.col("n") + before) / BLOCK)
    rows = samples.select("name", "n", "v", F.explode(F.sequence(first, last)).alias("block"))
    return rows.withColumn("own", F.col("block") == _block())


def _moved(samples: DataFrame, width: int, value: Column, name: str) -> DataFrame:
    """value over the window of width samples around each sample."""
    before, after = width // 2, width - width // 2 - 1
    around = Window.partitionBy("name", "block").orderBy("n").rowsBetween(-before, after)
    return _with_neighbours(samples, before, after).select("name", "n", "own", value.over(around).alias(name)).where("own").drop("own")


def moving_mean(samples: DataFrame, width: int = 50) -> DataFrame:
    """(name, n, mean): mean magnitude over width samples, zeros beyond the ends."""
    return _moved(samples, width, F.sum(F.abs("v")), "sum").select("name", "n", (F.col("sum") / width).alias("mean"))


def moving_max(samples: DataFrame, width: int) -> DataFrame:
    """(name, n, peak): largest magnitude over width samples."""
    return _moved(samples, width, F.max(F.abs("v")), "peak")


def moving_median(samples: DataFrame, width: int = 500) -> DataFrame:
    """(name, n, median): element width//2 of the sorted magnitudes over width samples, the signal's ends repeated."""
    before, after = width // 2, width - width // 2 - 1

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("n")
        own, n, v = (block.column(c).to_numpy() for c in ("own", "n", "v"))
        place = np.flatnonzero(own)
        if not len(place):
            return block.slice(0, 0).select(["name", "n"]).append_column("median", pa.array([], pa.float64()))
        first, last = place[0], place[-1]  # what is missing before or after lies beyond the signal
        padded = np.concatenate([np.full(before - first, abs(v[0])), np.abs(v), np.full(after - (len(v) - 1 - last), abs(v[-1]))])
        return block.slice(first, len(place)).select(["name", "n"]).append_column("median", pa.array(kernels.window_order(padded, width, before)))

    rows = _with_neighbours(samples, before, after)
    return rows.groupBy("name", "block").applyInArrow(run, f"name {samples.schema['name'].dataType.simpleString()}, n {samples.schema['n'].dataType.simpleString()}, median double")


def resampled(samples: DataFrame, fs: int, rate: int) -> DataFrame:
    """(name, n, v) at another rate, any whole one: ceil(size * rate / fs) samples from the first one on, zeros beyond the signal's ends."""
    up, down = kernels.ratio(fs, rate)
    reach = kernels.resampling_taps(up, down)[0]

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("n")
        own, n, v = (block.column(c).to_numpy() for c in ("own", "n", "v"))
        place = n[own]
        first, last = (-(-int(place[0]) * up // down), -(-(int(place[-1]) + 1) * up // down)) if len(place) else (0, 0)
        made = kernels.resampled_part(v, int(n[0]), first, last, up, down)
        return pa.table({"name": pa.repeat(block.column("name")[0], len(made)), "n": np.arange(first, last), "v": made})

    rows = _with_neighbours(samples.select("name", F.col("n").cast("long").alias("n"), "v"), reach, reach)
    return rows.groupBy("name", "block").applyInArrow(run, f"name {samples.schema['name'].dataType.simpleString()}, n long, v double")


def binned(samples: DataFrame, count: int) -> DataFrame:
    """(name, x): each whole signal as count mean values of equal parts of it; parts without a sample, of signals shorter than that, are 0."""
    sizes = samples.groupBy("name").agg(F.count("*").alias("size"))
    parts = samples.join(sizes, "name").groupBy("name", F.floor(F.col("n") * count / F.col("size")).cast("int").alias("i")).agg(F.avg("v").alias("v"))
    found = parts.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("at"))  # at most count of them
    return found.select("name", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0))).alias("x"))


def valid_interval(levels: DataFrame, first: Column, last: Column) -> DataFrame:
    """(name, start, stop): from the first sample whose level v is under first, to the next one under last. Signals without either are left out."""
    starts = levels.where(F.col("v") < first).groupBy("name").agg(F.min("n").alias("start"))
    stops = levels.join(starts, "name").where((F.col("n") >= F.col("start")) & (F.col("v") < last))
    return stops.groupBy("name", "start").agg(F.min("n").alias("stop"))


def line_fit(samples: DataFrame) -> DataFrame:
    """(name, slope, intercept) of v over n by least squares."""
    return samples.groupBy("name").agg(F.regr_slope("v", "n").alias("slope"), F.regr_intercept("v", "n").alias("intercept"))


def convolution(signals: DataFrame, responses: DataFrame) -> DataFrame:
    """(name, n, v): each signal with its own response (same name), the middle part of the signal's length. For short arrays; long ones go through functions.udfs.convolve."""
    a, b = signals.withColumnRenamed("v", "x"), responses.select("name", F.col("n").alias("k"), F.col("v").alias("h"))
    sizes = a.groupBy("name").agg(F.count("*").alias("size"))
    lead = b.groupBy("name").agg(F.floor((F.count("*") - 1) / 2).alias("lead"))
    full = a.join(b, "name").groupBy("name", (F.col("n") + F.col("k")).alias("m")).agg(F.sum(F.col("x") * F.col("h")).alias("v"))
    return full.join(sizes, "name").join(lead, "name").where("m >= lead and m < lead + size").select("name", (F.col("m") - F.col("lead")).alias("n"), "v")
