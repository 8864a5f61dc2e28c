"""Audio files and synthetic responses as signal tables."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions import kernels, udfs
from echolith.functions.arrays import peak_normalise
from echolith.schema import FS, SECONDS, TR_SWEEP, stem, sweep_values
from echolith.sources.flac import decode_flac


def decode_wave(content: bytes, fs: int, seconds: float) -> np.ndarray:
    """Mono samples of a PCM file at fs, at most so many seconds of it. Channels are averaged; another sample rate is converted by a polyphase filter."""
    with wave.open(io.BytesIO(content)) as f:
        rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
        raw = f.readframes(int(seconds * rate))
    if width == 1:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = np.concatenate([np.zeros((len(b), 1), np.uint8), b], axis=1).view("<i4").ravel() / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(axis=1)
    return kernels.resampled(x, rate, fs)[: int(seconds * fs)]


def decode_audio(content: bytes, fs: int, seconds: float) -> np.ndarray:
    """Mono samples of a WAV or FLAC file at fs, at most so many seconds of it."""
    if content[:4] != b"fLaC":
        return decode_wave(content, fs, seconds)
    x, rate, depth = decode_flac(content, seconds)
    return kernels.resampled(x.mean(axis=0) / 2.0 ** (depth - 1), rate, fs)[: int(seconds * fs)]


def _decode(fs: int, seconds: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    x, error = decode_audio(content, fs, seconds).astype(np.float32), None
                except (wave.Error, EOFError, ValueError) as e:
                    x, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([x], pa.list_(pa.float32())), pa.array([error], pa.string())], ["path", "x", "error"])

    return run


def decoded(files: DataFrame, fs: int = FS, seconds: float = SECONDS, normalise: bool = True) -> DataFrame:
    """(path, name, fs, x, error) of files (path, content): a file that can't be read keeps its row, with the error."""
    out = files.select("path", "content").mapInArrow(_decode(fs, seconds), "path string, x array<float>, error string")
    x = peak_normalise(F.col("x")) if normalise else F.col("x")
    return out.select("path", stem(F.col("path")).alias("name"), F.lit(fs).alias("fs"), x.alias("x"), "error")


def audio_files(spark: SparkSession, folder: str, pattern: str = "*.{wav,WAV,flac,FLAC}", recursive: bool = True) -> DataFrame:
    """(path, length, content) of a folder's files. Without content selected, Spark doesn't open them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def read_audio(spark: SparkSession, folder: str, fs: int = FS, seconds: float = SECONDS, normalise: bool = True, skip: str | None = None) -> DataFrame:
    """The signals of a folder; skip leaves out files whose name holds it."""
    files = audio_files(spark, folder)
    if skip:
        files = files.where(~stem(F.col("path")).contains(skip))
    return decoded(files, fs, seconds, normalise)


def synthetic_responses(spark: SparkSession, each: int = 100, sweep: tuple = TR_SWEEP, fs: int = FS, seed: int = 0) -> DataFrame:
    """(name, tr, seed, fs, x): so many responses for each decay time of a sweep, made where they are needed."""
    times = F.array(*(F.lit(v) for v in sweep_values(*sweep)))
    rows = spark.range(each).select("id", F.explode(times).alias("tr")).withColumn("seed", F.xxhash64("id", "tr", F.lit(seed)))
    name = F.concat(F.lit("sintetica_Seed"), F.col("seed").cast("string"), F.lit("_Tr"), F.format_string("%.1f", "tr"))
    return rows.select(name.alias("name"), "tr", "seed", F.lit(fs).alias("fs"), udfs.synthetic_response(F.col("tr"), F.col("seed"), fs).alias("x"))


def wave_bytes(x: list[float], fs: int) -> bytes:
    """A 16-bit PCM file of samples within -1 and 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(fs)
        f.writeframes((np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def with_wave_content(signals: DataFrame, fs: int = FS) -> DataFrame:
    """(name, content): each signal as the bytes of a WAV file, to be written to any binary sink; null without samples to write."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):  # one signal at a time
                x = b.column("x")[i].values
                content = None if x is None else wave_bytes(x.to_numpy(zero_copy_only=False), fs)
                yield pa.RecordBatch.from_arrays([b.column("name").slice(i, 1), pa.array([content], pa.binary())], ["name", "content"])

    return signals.select(F.col("name").cast("string"), F.col("x").cast("array<double>")).mapInArrow(run, "name string, content binary")
