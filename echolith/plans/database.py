"""The record table: responses and their variants, described per band, joined with the speech of their split, one record per (speech, variant, band).

What doesn't depend on speech (variants, band-split responses, descriptors) is made before speech is met, in one pass over the responses, and rejected bands never meet it. Decay parameters are estimated once per (response, band) and reused for every decay time of the sweep. Responses and speech meet block by block. What is rejected is kept, with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.functions import kernels, udfs
from echolith.operators.ranks import chance
from echolith.schema import BANDS, DRR_SWEEP, FS, ORDER, TR_SWEEP, audio_name, dataset_name, sweep_values, tr_drr_tag, tr_tag
from echolith.sources import tables


@dataclass(frozen=True)
class Settings:
    """What a record table depends on."""

    bands: tuple[int, ...] = BANDS
    fs: int = FS
    order: int = ORDER
    kind: str = "octave band"
    noise_db: float = -60.0
    add_noise: bool = False
    snr: tuple[float, float] = (-5.0, 20.0)
    tr: tuple[float, float, float] = TR_SWEEP
    drr: tuple[float, float, float] = DRR_SWEEP
    drr_draws: int = 5
    seed: int = 2222

    @property
    def name(self) -> str:
        return dataset_name(self.noise_db, self.add_noise, self.tr, self.drr, self.snr, bands="_".join(map(str, self.bands)), order=self.order, fs=self.fs, seed=self.seed)


def _longer(x: np.ndarray, seeds: list[int], s: Settings) -> Iterator[np.ndarray]:
    """The response x at each decay time of the sweep, its noise replaced by the bands' modelled decays. Decay parameters are fitted once."""
    head, late = kernels.head_and_late(x, s.fs)
    full, bands = kernels.full_band_decay(late, s.fs), []
    for band, seed in zip(s.bands, seeds):
        own = kernels.band_passed(late, band, s.fs, s.order, s.kind)
        crossing, amplitude, tau, floor = kernels.decay_parameters(own, s.fs)
        if not np.isfinite([amplitude, tau, floor, full]).all():
            raise ValueError("the decay can't be estimated")
        bands.append((own, int(crossing), amplitude, tau, seed))
    for i, tr in enumerate(sweep_values(*s.tr)):
        parts = (kernels.rescaled(kernels.denoised(own, s.fs, crossing, amplitude, tau, seed + i), s.fs, tr, full, tau) for own, crossing, amplitude, tau, seed in bands)
        yield kernels.peak_normalised(np.concatenate([head, np.sum(list(parts), axis=0)]))


def _at_decay_times(x: np.ndarray | None, seeds: list[int], s: Settings) -> Iterator[tuple[float, np.ndarray | None, str | None]]:
    """(tr, signal, error) for each decay time of the sweep, one signal at a time."""
    made, error = iter(()), "EmptySignal"
    if x is not None and len(x):
        made, error = _longer(np.asarray(x, float), seeds, s), None
    for tr in sweep_values(*s.tr):
        y = None
        try:
            with np.errstate(all="ignore"):
                y = next(made, None)
        except udfs.FAILURES as e:  # the decay times after this one have the same error
            error = type(e).__name__
        yield tr, y, error


def _seeds(s: Settings) -> Column:
    return F.array(*(F.xxhash64("rir_name", F.lit(b), F.lit(s.seed)) for b in s.bands)).cast("array<long>").alias("seeds")


def tr_variants(responses: DataFrame, s: Settings, source: udfs.Source = udfs.GIVEN, kind: str = "x array<double>", of: Callable[[np.ndarray | None], tuple] = lambda y: (y,)) -> DataFrame:
    """(rir_name, split, tr, x, error): each response, which source says what it is made of, at each decay time of the sweep; where a decay can't be estimated in every band, x is null and error says why. A response's bands stay together in one row's work, so nothing shuffles, and one variant at a time is made. Each variant's modelled decay has noise of its own. With kind and of, what of makes of each variant (or of null) stands instead of x, and no variant leaves the function."""
    make, inputs = source

    def each(name: str, split: str, seeds: list[int], *x) -> Iterator[tuple]:
        for tr, y, error in _at_decay_times(make(*x), seeds, s):
            yield name, split, tr, *of(y), error

    return udfs.flat_map(responses.select("rir_name", "split", _seeds(s), *inputs), each, f"rir_name string, split string, tr double, {kind}, error string")


def every_variant(responses: DataFrame, s: Settings, source: udfs.Source = udfs.GIVEN, describe: bool = True) -> DataFrame:
    """(rir_name, split, tr, drr, aug_tag, x, error, measures, rejects): variants() with its decay time and ratio, described in the same pass: measures has the bands with descriptors, rejects those without and why. The x of a variant that no band describes is null.

    All of a response is one row's work: it is made (see tr_variants()) and fitted once, and its variants leave Python in pieces of udfs.MADE_BYTES, never as a batch of as many signals as rows fit a batch. Without describe, measures and rejects are empty and every x stays.
    """
    make, inputs = source
    values, ratios = sweep_values(*s.tr), sweep_values(*s.drr)

    def made(augment: bool, seeds: list[int], drawn: list[bool], x: np.ndarray | None) -> Iterator[tuple]:
        yield None, None, x, None
        if augment:
            for (tr, y, error), chosen in zip(_at_decay_times(x, seeds, s), drawn):
                yield tr, None, y, error
                for drr in ratios if chosen else []:
                    z = udfs.result(kernels.with_direct_ratio, y, s.fs, drr)
                    yield tr, drr, z, None if z is not None else error or "RatioNotReached"

    def each(name: str, split: str, augment: bool, seeds: list[int], drawn: list[bool], *x) -> Iterator[tuple]:
        signal = make(*x)
        for tr, drr, y, error in made(augment, seeds, drawn, None if signal is None else np.asarray(signal, float)):
            measures, rejects = [], []
            for band, *found, why in _described(y, error, s) if describe else ():
                if why:
                    rejects.append({"band": band, "error": why})
                else:
                    measures.append({"band": band, "descriptors": dict(zip(_MEASURES[:4], found)), "drr": found[-1]})
            yield name, split, tr, drr, y if measures or not describe else None, error, measures, rejects

    drawn = F.array(*(chance(F.col("rir_name"), F.lit(tr), seed=s.seed, out_of=len(values), kept=s.drr_draws) for tr in values)).cast("array<boolean>").alias("drawn")
    rows = responses.select("rir_name", "split", F.coalesce("augment", F.lit(False)).alias("augment"), _seeds(s), drawn, *inputs)
    out = udfs.flat_map(rows, each, f"rir_name string, split string, tr double, drr double, x array<double>, error string, measures array<{_MEASURE}>, rejects array<struct<band:int,error:string>>")
    tag = F.when(F.col("tr").isNull(), "original").when(F.col("drr").isNull(), tr_tag(F.col("tr"))).otherwise(tr_drr_tag(F.col("tr"), F.col("drr")))
    return out.select("rir_name", "split", "tr", "drr", tag.alias("aug_tag"), "x", "error", "measures", "rejects")


def variants(responses: DataFrame, s: Settings, source: udfs.Source = udfs.GIVEN) -> DataFrame:
    """(rir_name, split, aug_tag, x, error) from (rir_name, split, augment, x): each response itself and, where augment is set, at each decay time, and for a random few of those at each direct-to-reverberant ratio. A variant that can't be made has a null x and its error."""
    return every_variant(responses, s, source, describe=False).select("rir_name", "split", "aug_tag", "x", "error")


_MEASURES = ("t30", "c50", "c80", "d50", "drr")
_DESCRIPTORS = "struct<t30:double,c50:double,c80:double,d50:double>"
_MEASURE = f"struct<band:int,descriptors:{_DESCRIPTORS},drr:double>"


def _described(x: np.ndarray | None, error: str | None, s: Settings) -> Iterator[tuple]:
    """For each band a signal's measures, and why there are none: its own error, if it has one, else null if there are."""
    spectra: dict[int, np.ndarray] = {}
    one = lambda v, band: kernels.descriptors(kernels.band_passed(v, band, s.fs, s.order, s.kind, spectra), s.fs, s.noise_db)
    for band in s.bands:
        yield (band, *[None] * len(_MEASURES), error) if error else (band, *udfs.attempted(one, list(_MEASURES), x, band))


def described(responses: DataFrame, s: Settings) -> DataFrame:
    """Each variant per band with t30, c50, c80, d50, drr, and error: why it can't be described (its own error, if it has one), else null. A variant goes to Python once for all its bands."""

    def each(name: str, split: str, tag: str, x: np.ndarray | None, error: str | None) -> Iterator[tuple]:
        for row in _described(x, error, s):
            yield name, split, tag, *row

    rows = responses.select("rir_name", "split", "aug_tag", "x", "error" if "error" in responses.columns else F.lit(None).cast("string").alias("error"))
    return udfs.flat_map(rows, each, "rir_name string, split string, aug_tag string, band int, " + ", ".join(f"{n} double" for n in _MEASURES) + ", error string")


def band_features(signals: DataFrame, s: Settings) -> DataFrame:
    """(name, band, tae, error) from signals (name, x): each signal's bands, peak-normalised, as envelope features; tae is null where error says why. A signal goes to Python once for all its bands."""

    def one(x: np.ndarray, band: int) -> np.ndarray:
        return kernels.temporal_envelope(kernels.peak_normalised(kernels.band_passed(x, band, s.fs, s.order, s.kind)), s.fs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for name, x in zip(df["name"], df["x"]):
                rows = []
                for band in s.bands:
                    try:
                        if x is None or not len(x):
                            raise ValueError("no samples")
                        with np.errstate(all="ignore"):
                            rows.append((name, band, one(np.asarray(x, float), band), None))
                    except udfs.FAILURES as e:
                        rows.append((name, band, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["name", "band", "tae", "error"])

    return signals.select(F.col("name").cast("string"), "x").mapInPandas(run, "name string, band int, tae array<double>, error string")


def _in_blocks(rows: DataFrame, sizes: DataFrame, names: list[str], own: str, other: str) -> DataFrame:
    """rows once for each block of the other side of their split, in a block of their own side by a hash of their names."""
    rows = rows.join(F.broadcast(sizes), "split").withColumn(own, F.pmod(F.xxhash64(*names), F.col(f"{own}s")))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1))).drop("wet_blocks", "dry_blocks")


def features(wet: DataFrame, speech: DataFrame, s: Settings) -> DataFrame:
    """A row for each response (rir_name, aug_tag, split, h, measures) with each speech (speech_name, split, dry) of its split and each of its measures: tae, snr and error instead of h, dry and measures. That is the speech through the response, per band, with noise if it is to be added; tae is null where error says why.

    Both sides are cut into blocks, speech of about BLOCK signals, responses of LONGER times as many or, where that gives too few blocks for the cores, fewer. A task gets a block of each: a signal's spectrum is found once for all signals that it meets there, the responses' one after the other, and a signal is shuffled once for each block of the other side.
    """
    cores = wet.sparkSession.sparkContext.defaultParallelism
    counts = lambda rows, name, least, most: rows.groupBy("split").agg(F.greatest(F.ceil(F.count("*") / most), F.least(F.ceil(F.count("*") / BLOCK), F.lit(least))).alias(name))
    sizes = counts(wet, "wet_blocks", 4 * cores, LONGER * BLOCK).join(counts(speech, "dry_blocks", 1, BLOCK), "split")  # a row a split
    low, wide = s.snr[0], s.snr[1] - s.snr[0]

    def one(audio: np.ndarray, band: int, seed: int, spectra: dict[int, np.ndarray]) -> tuple[np.ndarray, float]:
        own, snr = kernels.band_passed(audio, band, s.fs, s.order, s.kind, spectra), float("nan")
        if s.add_noise:
            snr = low + wide * (seed % (1 << 30)) / (1 << 30)
            own = kernels.with_noise(own, snr, seed)
        return kernels.temporal_envelope(own, s.fs), snr

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        signals = lambda t, c: [None if v.values is None else v.values.to_numpy(zero_copy_only=False) for v in t.column(c)]
        hs, xs = signals(left, "h"), signals(right, "dry")
        longest = lambda found: max((len(v) for v in found if v is not None), default=0)
        size = 1 << max(longest(hs) + longest(xs) - 2, 0).bit_length()
        spectrum = lambda v: None if v is None or not len(v) else np.fft.rfft(v, size)
        dry, out = list(zip(right.column("speech_name").to_pylist(), xs, map(spectrum, xs))), []
        for r, h in zip(left.drop_columns(["h"]).to_pylist(), hs):
            fh = spectrum(h)
            for name, x, fx in dry:
                audio = None if fh is None or fx is None else kernels.middle(np.fft.irfft(fx * fh, size), len(x), len(h))
                spectra: dict[int, np.ndarray] = {}
                for m in r["measures"]:
                    tae, snr, error = None, None, "EmptySignal"
                    if audio is not None:
                        try:
                            with np.errstate(all="ignore"):
                                (tae, snr), error = one(audio, m["band"], kernels.seed_of(name, r["rir_name"], r["aug_tag"], m["band"], s.seed), spectra), None
                        except udfs.FAILURES as e:
                            error = type(e).__name__
                    out.append({"split": r["split"], "speech_name": name, "rir_name": r["rir_name"], "aug_tag": r["aug_tag"], **m, "tae": tae, "snr": snr, "error": error})
        return pa.Table.from_pylist(out, schema=_FEATURE_ARROW)

    left = _in_blocks(wet.select("split", "rir_name", "aug_tag", "h", "measures"), sizes, ["rir_name", "aug_tag"], "wet_block", "dry_block")
    right = _in_blocks(speech.select("split", "speech_name", "dry"), sizes, ["speech_name"], "dry_block", "wet_block")
    by = ["split", "wet_block", "dry_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, _FEATURES)


#: Signals of a block of speech, about, and how many times as many a block of responses has at most.
BLOCK, LONGER = 8, 8
_FEATURES = f"split string, speech_name string, rir_name string, aug_tag string, band int, descriptors {_DESCRIPTORS}, drr double, tae array<double>, snr double, error string"
_FEATURE_ARROW = pa.schema(
    [*((c, pa.string()) for c in ("split", "speech_name", "rir_name", "aug_tag")), ("band", pa.int32()), ("descriptors", pa.struct([(c, pa.float64()) for c in ("t30", "c50", "c80", "d50")])),
     ("drr", pa.float64()), ("tae", pa.list_(pa.float64())), ("snr", pa.float64()), ("error", pa.string())]
)


def outcomes(responses: DataFrame, speech: DataFrame, s: Settings = Settings(), keep: Callable[[DataFrame], DataFrame] = lambda df: tables.shared(df, "variants"), source: udfs.Source = udfs.GIVEN) -> DataFrame:
    """The record table of responses (rir_name, split, augment, x, or instead of x what source makes it of) and speech (speech_name, split, x), and what didn't come to be a record: each (speech, variant, band), or where a variant can't be described in a band each (variant, band) without speech_name, with error null for records and else why there is none.

    Variants with their description are used three times, to count them, to convolve them and for the rejects; keep writes them to a shared table. rejected tells records and rejects apart: written by it (tables.write_outcomes), both come from one pass.
    """
    every = keep(every_variant(responses, s, source))
    wet = every.where(F.size("measures") > 0).select("rir_name", "aug_tag", "split", F.col("x").alias("h"), "measures")
    out = features(wet, speech.select("speech_name", "split", F.col("x").cast("array<double>").alias("dry")), s)
    told = every.select("split", "rir_name", "aug_tag", F.explode("rejects").alias("r")).select("split", "rir_name", "aug_tag", "r.*")
    out = out.unionByName(told, allowMissingColumns=True)
    return out.select(
        audio_name(F.col("speech_name"), F.col("rir_name"), F.col("aug_tag")).alias("reverbed_audio"), F.col("split").alias("type_data"), "band", "speech_name", "rir_name", "aug_tag",
        "descriptors", "drr", "tae", "snr", "error", F.col("error").isNotNull().alias("rejected"),
    )


def records(responses: DataFrame, speech: DataFrame, s: Settings = Settings(), keep: Callable[[DataFrame], DataFrame] = lambda df: tables.shared(df, "variants"), source: udfs.Source = udfs.GIVEN) -> DataFrame:
    """The rows of outcomes() that are records."""
    return outcomes(responses, speech, s, keep, source).where("not rejected").drop("error", "rejected")
