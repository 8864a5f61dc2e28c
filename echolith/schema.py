"""Schemas of signals and records, and the grammar of record names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A mono signal: one row, its samples as an array.
SIGNAL = "name string, fs int, x array<float>"
#: A row of the record table: one reverberant signal in one band.
RECORD = "reverbed_audio string, type_data string, band int, speech_name string, rir_name string, aug_tag string, descriptors struct<t30:double,c50:double,c80:double,d50:double>, drr double, tae array<double>, snr double"
#: Octave bands (Hz), sample rate, filter order, feature rate: fixed values of the experiments.
BANDS = (125, 250, 500, 1000, 2000, 4000, 8000)
FS, ORDER, FEATURE_RATE, FEATURE_SIZE, SECONDS = 16_000, 4, 40, 200, 5.0
#: Sweeps (start, stop, step): decay times in seconds, direct-to-reverberant ratios in dB.
TR_SWEEP, DRR_SWEEP = (0.2, 3.1, 0.1), (-6.0, 19.0, 1.0)


def stem(path: Column) -> Column:
    """The file name without folders and its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def audio_name(speech: Column, rir: Column, tag: Column) -> Column:
    """speech|rir|tag."""
    return F.concat_ws("|", speech, rir, tag)


def name_part(name: Column, part: int) -> Column:
    """Part 0 (speech), 1 (impulse response) or 2 (tag) of a record's name; null if there is none."""
    return F.get(F.split(name, r"\|"), F.lit(part))


def tr_tag(tr: Column) -> Column:
    return F.format_string("TR_var_%.2f", tr)


def tr_drr_tag(tr: Column, drr: Column) -> Column:
    return F.format_string("TR_%.2f_DRR_var_%.2f", tr, drr)


def sweep_values(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... below stop."""
    n = int(-(-(stop - start) // step)) if step > 0 else 0
    values = [start + i * step for i in range(n + 1)]
    return [round(v, 10) for v in values if v < stop - 1e-9]


def dataset_name(noise_db: float, add_noise: bool, tr: tuple, drr: tuple, snr: tuple, **more) -> str:
    """The name of a record table from its parameters; whatever else the rows depend on goes into more, so that two settings never share a name."""
    parts = [f"noise{noise_db:g}", f"add{int(add_noise)}", "tr" + "_".join(f"{v:g}" for v in tr), "drr" + "_".join(f"{v:g}" for v in drr), "snr" + "_".join(f"{v:g}" for v in snr)]
    return "-".join(["base", *parts, *(f"{k}{v}" for k, v in sorted(more.items()))])
