"""Arrow functions over array columns: each row's array goes to a numpy kernel.

A kernel that fails on a row never fails the task: results are null, or a struct whose error says what went wrong. Set spark.sql.execution.arrow.maxRecordsPerBatch to about 64 for signals of 80 000 samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from echolith.functions import kernels
from echolith.schema import FEATURE_RATE, FEATURE_SIZE, FS, ORDER


#: What a kernel raises for a signal that it can't take.
FAILURES = (ValueError, ZeroDivisionError, IndexError, FloatingPointError, OverflowError)


def _attempt(kernel: Callable, x, *more):
    """The kernel's result, or the error."""
    if x is None or not len(x):
        return None
    try:
        with np.errstate(all="ignore"):
            return kernel(np.asarray(x, float), *more)
    except FAILURES as e:
        return e


def result(kernel: Callable, x, *more):
    """The kernel's result, None where there is none."""
    r = _attempt(kernel, x, *more)
    return None if isinstance(r, Exception) else r


def _array(kernel: Callable, *columns: pd.Series) -> pd.Series:
    return pd.Series([result(kernel, *row) for row in zip(*columns)], dtype=object)


def attempted(kernel: Callable, names: list[str], x, *more) -> tuple:
    """The kernel's numbers and why there are none, else null."""
    r = _attempt(kernel, x, *more)
    failed = r is None or isinstance(r, Exception) or not np.isfinite(np.array(r, float)).all()
    error = "EmptySignal" if r is None else type(r).__name__ if isinstance(r, Exception) else "NotFinite" if failed else None
    return (*([None] * len(names) if failed else r), error)


def _struct(kernel: Callable, names: list[str], *columns: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([attempted(kernel, names, *row) for row in zip(*columns)], columns=[*names, "error"])


def band_pass(x: Column, band: Column, fs: int = FS, order: int = ORDER, kind: str = "octave band") -> Column:
    """The signal in one octave (or third-octave) band: causal, same length. Null for a band that doesn't fit the sample rate."""
    if order <= 0 or fs <= 0:
        raise ValueError("order and sample rate must be positive")
    f = pandas_udf(lambda xs, bs: _array(lambda v, b: kernels.band_passed(v, float(b), fs, order, kind), xs, bs), "array<double>", F.PandasUDFType.SCALAR)
    return f(x, band)


def low_pass(x: Column, cut: float = FEATURE_RATE / 2, fs: int = FS, order: int = ORDER) -> Column:
    return pandas_udf(lambda xs: _array(lambda v: kernels.filtered(v, order, None, cut, fs), xs), "array<double>", F.PandasUDFType.SCALAR)(x)


def envelope(x: Column) -> Column:
    """Magnitude of the analytic signal."""
    return pandas_udf(lambda xs: _array(kernels.envelope, xs), "array<double>", F.PandasUDFType.SCALAR)(x)


def resampled(x: Column, fs: int, rate: int) -> Column:
    """The signal at another rate, any whole one: ceil(n * rate / fs) samples, zeros beyond its ends."""
    return pandas_udf(lambda xs: _array(lambda v: kernels.resampled(v, fs, rate), xs), "array<double>", F.PandasUDFType.SCALAR)(x)


def convolve(x: Column, h: Column) -> Column:
    """x through the response h: length of x, centred, its peak 1."""
    return pandas_udf(lambda xs, hs: _array(lambda v, w: kernels.convolved(v, np.asarray(w, float)), xs, hs), "array<double>", F.PandasUDFType.SCALAR)(x, h)


def temporal_envelope(x: Column, fs: int = FS, rate: int = FEATURE_RATE, size: int = FEATURE_SIZE) -> Column:
    """The envelope feature; null unless it has exactly size samples."""
    return pandas_udf(lambda xs: _array(lambda v: kernels.temporal_envelope(v, fs, rate, size), xs), "array<double>", F.PandasUDFType.SCALAR)(x)


def moving_median(x: Column, width: int = 500) -> Column:
    return pandas_udf(lambda xs: _array(lambda v: kernels.moving_median(np.abs(v), width), xs), "array<double>", F.PandasUDFType.SCALAR)(x)


def pink_noise(n: Column, seed: Column) -> Column:
    """n samples of 1/f noise, the same for the same seed."""
    return pandas_udf(lambda ns, ss: pd.Series([kernels.pink_noise(int(k), int(s)) for k, s in zip(ns, ss)], dtype=object), "array<double>", F.PandasUDFType.SCALAR)(n, seed)


#: Bytes of made signals that a task's Python holds at once, about.
MADE_BYTES = 1 << 23


def with_made(rows: DataFrame, name: str, kind: str, make: Callable, *inputs: str) -> DataFrame:
    """rows with a column name of arrays that make gives for each row's inputs. Ten thousand small rows come to Python as one batch, and in an Arrow function their signals would be one too; here MADE_BYTES of them leave before others are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held, size = 0, [], 0
            for i, row in enumerate(zip(*(b.column(c) for c in inputs)), 1):
                held.append(make(*(v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) else v.as_py() for v in row)))
                size += held[-1].nbytes
                if size >= MADE_BYTES or i == len(b):
                    made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32)), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([*b.slice(first, i - first).columns, made], [*b.schema.names, name])
                    first, held, size = i, [], 0

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {own}" for c, own in rows.dtypes), f"`{name}` {kind}"]))


#: What makes a signal of a row's columns, and these columns.
Source = tuple[Callable, tuple[str, ...]]
#: The signal is in the row.
GIVEN: Source = (lambda x: x, ("x",))


def synthetic(fs: int = FS, noise_db: float | None = None) -> Source:
    """The responses that with_synthetic_response() gives."""
    return lambda tr, seed: _synthetic(tr, seed, fs, noise_db), ("tr", "seed")


def flat_map(rows: DataFrame, each: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that each gives for the values of each row (arrays of floating-point numbers as numpy arrays), in pieces()."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(lambda batches: pieces(batches, each, kinds), schema)


def pieces(batches: Iterator[pa.RecordBatch], each: Callable[..., Iterator[tuple]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What each gives for the batches' rows, in batches that end at about MADE_BYTES: what Python holds grows with neither its rows nor what they become."""
    held, size = [], 0
    for b in batches:
        for row in zip(*b.columns):
            for out in each(*map(_plain, row)):
                held.append(out)
                size += ROW_BYTES + sum(v.nbytes for v in out if isinstance(v, np.ndarray))
                if size >= MADE_BYTES:
                    yield _batch(held, kinds)
                    held, size = [], 0
    if held:
        yield _batch(held, kinds)


#: Bytes that a row counts besides its arrays.
ROW_BYTES = 1 << 10


def _plain(v: pa.Scalar):
    if isinstance(v, pa.ListScalar) and v.is_valid and pa.types.is_floating(v.type.value_type):
        return v.values.to_numpy(zero_copy_only=False)
    return v.as_py()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _synthetic(tr: float, seed: int, fs: int, noise_db: float | None) -> np.ndarray:
    """A synthetic response in single precision, or that with pink noise so many dB under it."""
    x = kernels.synthetic_response(float(tr), fs, int(seed)).astype(np.float32)
    return x if noise_db is None else kernels.with_noise(x.astype(float), noise_db, int(seed))


def of_synthetic(tr: Column, seed: Column, kind: str, kernel: Callable, fs: int = FS, noise_db: float | None = None) -> Column:
    """What the kernel makes (a tuple, or an array) of each response that with_synthetic_response() gives, one after the other: no response leaves the function, and no two are held."""

    def run(ts: pd.Series, ss: pd.Series) -> pd.Series | pd.DataFrame:
        out = [kernel(_synthetic(t, s, fs, noise_db)) for t, s in zip(ts, ss)]
        return pd.Series(out, dtype=object) if kind.startswith("array") else pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    return pandas_udf(lambda ts, ss: run(ts, ss), kind, F.PandasUDFType.SCALAR)(tr, seed)


def with_synthetic_response(rows: DataFrame, fs: int = FS, noise_db: float | None = None) -> DataFrame:
    """rows (tr, seed, ...) with x, synthetic_response() of each as float, or with pink noise so many dB under it as double."""
    return with_made(rows, "x", "array<float>" if noise_db is None else "array<double>", lambda tr, seed: _synthetic(tr, seed, fs, noise_db), "tr", "seed")


def synthetic_response(tr: Column, seed: Column, fs: int = FS) -> Column:
    """A synthetic impulse response of reverberation time tr, where batches are small."""
    return pandas_udf(lambda ts, ss: pd.Series([kernels.synthetic_response(float(t), fs, int(s)) for t, s in zip(ts, ss)], dtype=object), "array<float>", F.PandasUDFType.SCALAR)(tr, seed)


def decay_time(x: Column, fs: int = FS, noise_db: float = -60.0) -> Column:
    """struct<t30, noise_db, error>: reverberation time with the noise compensated; error names what kept it from being measured."""
    names = ["t30", "noise_db"]
    return pandas_udf(lambda xs: _struct(lambda v: kernels.decay_time(v, fs, noise_db), names, xs), "t30 double, noise_db double, error string", F.PandasUDFType.SCALAR)(x)


def decay_parameters(x: Column, fs: int = FS) -> Column:
    """struct<crossing, amplitude, tau, floor, error> of a band's late part."""
    names = ["crossing", "amplitude", "tau", "floor"]
    return pandas_udf(lambda xs: _struct(lambda v: kernels.decay_parameters(v, fs), names, xs), "crossing int, amplitude double, tau double, floor double, error string", F.PandasUDFType.SCALAR)(x)


def full_band_decay(x: Column, fs: int = FS) -> Column:
    """struct<tau, error> of a late part."""
    return pandas_udf(lambda xs: _struct(lambda v: (kernels.full_band_decay(v, fs),), ["tau"], xs), "tau double, error string", F.PandasUDFType.SCALAR)(x)


def head_and_late(x: Column, fs: int = FS) -> Column:
    """struct<head, late>: a response, peak-normalised, up to the end of its direct sound and after it."""

    def run(xs: pd.Series) -> pd.DataFrame:
        parts = [_attempt(kernels.head_and_late, x, fs) for x in xs]
        return pd.DataFrame({k: [None if p is None or isinstance(p, Exception) else p[i] for p in parts] for i, k in enumerate(("head", "late"))})

    return pandas_udf(lambda xs: run(xs), "head array<double>, late array<double>", F.PandasUDFType.SCALAR)(x)


def descriptors(x: Column, fs: int = FS, noise_db: float = -60.0) -> Column:
    """struct<t30, c50, c80, d50, drr, error> of a band-passed response."""
    names = ["t30", "c50", "c80", "d50", "drr"]
    return pandas_udf(lambda xs: _struct(lambda v: kernels.descriptors(v, fs, noise_db), names, xs), "t30 double, c50 double, c80 double, d50 double, drr double, error string", F.PandasUDFType.SCALAR)(x)


def denoised(x: Column, crossing: Column, amplitude: Column, tau: Column, seed: Column, fs: int = FS) -> Column:
    """A band's late part, its noise replaced by its modelled decay; null if that would start too early."""
    one = lambda v, c, a, t, s: kernels.denoised(v, fs, int(c), a, t, int(s))
    return pandas_udf(lambda xs, c, a, t, s: _array(one, xs, c, a, t, s), "array<double>", F.PandasUDFType.SCALAR)(x, crossing, amplitude, tau, seed)


def rescaled(x: Column, tr: Column, tau_full: Column, tau_band: Column, fs: int = FS) -> Column:
    """A band's decay stretched to a full-band reverberation time."""
    one = lambda v, tr, f, b: kernels.rescaled(v, fs, tr, f, b)
    return pandas_udf(lambda xs, tr, f, b: _array(one, xs, tr, f, b), "array<double>", F.PandasUDFType.SCALAR)(x, tr, tau_full, tau_band)


def with_late(head: Column, *bands: Column) -> Column:
    """A response from its head and the bands of its late part, peak-normalised."""
    one = lambda h, *late: kernels.peak_normalised(np.concatenate([h, np.sum(late, axis=0)]))
    return pandas_udf(lambda *cols: _array(one, *cols), "array<double>", F.PandasUDFType.SCALAR)(head, *bands)


def with_direct_ratio(x: Column, target_db: Column, fs: int = FS) -> Column:
    """functions.arrays.with_direct_ratio for long signals."""
    return pandas_udf(lambda xs, t: _array(lambda v, db: kernels.with_direct_ratio(v, fs, db), xs, t), "array<double>", F.PandasUDFType.SCALAR)(x, target_db)


def with_noise(x: Column, snr_db: Column, seed: Column) -> Column:
    """x with pink noise at a signal-to-noise ratio."""
    return pandas_udf(lambda xs, d, s: _array(lambda v, db, k: kernels.with_noise(v, db, int(k)), xs, d, s), "array<double>", F.PandasUDFType.SCALAR)(x, snr_db, seed)


def register(spark: SparkSession, fs: int = FS) -> list[str]:
    """The measures as SQL functions: acoustic_<name>(array, ...)."""
    from pyspark.sql.types import ArrayType, DoubleType

    doubles = ArrayType(DoubleType())
    made = {
        "acoustic_band_pass": pandas_udf(lambda x, b: _array(lambda v, band: kernels.band_passed(v, float(band), fs), x, b), doubles, F.PandasUDFType.SCALAR),
        "acoustic_envelope": pandas_udf(lambda x: _array(kernels.envelope, x), doubles, F.PandasUDFType.SCALAR),
        "acoustic_feature": pandas_udf(lambda x: _array(lambda v: kernels.temporal_envelope(v, fs), x), doubles, F.PandasUDFType.SCALAR),
        "acoustic_convolve": pandas_udf(lambda x, h: _array(lambda v, w: kernels.convolved(v, np.asarray(w, float)), x, h), doubles, F.PandasUDFType.SCALAR),
        "acoustic_decay_time": pandas_udf(lambda x: _struct(lambda v: kernels.decay_time(v, fs, -60.0), ["t30", "noise_db"], x), "t30 double, noise_db double, error string", F.PandasUDFType.SCALAR),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
