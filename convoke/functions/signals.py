"""Audio signals as arrays: levels, cuts, gains, resampling. Arrow batches in, numpy within a row."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rms(x: Column) -> Column:
    """Root mean square of an array of samples; null for an empty one."""
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.nullif(F.size(x), F.lit(0)))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.nullif(rms(x), F.lit(0.0)))


def to_float(x: Column) -> Column:
    """16-bit samples as numbers in -1 .. 1."""
    return F.transform(x, lambda v: v / F.lit(32768.0))


def to_int16(x: Column) -> Column:
    """Numbers in -1 .. 1, held there, as 16-bit samples cut towards zero."""
    return F.transform(x, lambda v: (F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int"))


def gain(x: Column, db: float = 40.0) -> Column:
    """Louder by some decibels, held within -1 .. 1."""
    return F.transform(x, lambda v: F.least(F.greatest(v * 10 ** (db / 20), F.lit(-1.0)), F.lit(1.0)))


def shifted(x: Column, n: int) -> Column:
    """Moved n samples to the right, around the end."""
    k = F.pmod(F.lit(n), F.greatest(F.size(x), F.lit(1)))
    return F.concat(F.slice(x, F.size(x) - k + 1, k), F.slice(x, F.lit(1), F.size(x) - k))


def levelled(x: Column, db: float = -20.0) -> Column:
    """To a level in decibels of its root mean square; silence stays as it is."""
    scale = F.coalesce(F.lit(10 ** (db / 20)) / F.nullif(rms(x), F.lit(0.0)), F.lit(1.0))
    return F.transform(x, lambda v: v * scale)


def cut(rows: DataFrame, rate: int, window_ms: int, step_ms: int | None = None, db: float | None = None) -> DataFrame:
    """Windows of the signal in column x: all other columns, no, x, each brought to a level (db) if one is given. What doesn't
    fill a window at the end is left out; a signal shorter than a window has none."""
    width, step = rate * window_ms // 1000, rate * (step_ms or window_ms) // 1000
    n = F.floor((F.size("x") - width) / step).cast("int") + 1
    each = rows.where(F.size("x") >= width).withColumn("no", F.explode(F.sequence(F.lit(0), n - 1)))
    each = each.withColumn("x", F.slice("x", F.col("no") * step + 1, width))
    return each if db is None else each.withColumn("x", levelled(F.col("x"), db))


def joined_ranges(x: Column, ranges: Column, rate: int) -> Column:
    """The parts of a signal between times (array of struct start, end in seconds), one after the other; a range that
    isn't within the signal raises."""
    bad = F.exists(ranges, lambda r: (r["start"] < 0) | (r["end"] <= r["start"]) | (r["end"] * rate > F.size(x)))
    parts = F.transform(ranges, lambda r: F.slice(x, (r["start"] * rate).cast("int") + 1, ((r["end"] - r["start"]) * rate).cast("int")))
    return F.when(bad, F.raise_error(F.lit("range outside the signal"))).otherwise(F.flatten(parts))


def resample(x: np.ndarray, old: int, new: int, kind: str = "linear") -> np.ndarray:
    """A signal at another rate: linear, next (the sample at or after), fourier, or lanczos (three lobes)."""
    n = round(len(x) * new / old)
    if not n or not len(x):
        return np.zeros(0)
    at = np.arange(n) * (old / new)
    if kind == "linear":
        return np.interp(at, np.arange(len(x)), x)
    if kind == "next":
        return x[np.minimum(np.searchsorted(np.arange(len(x)), at), len(x) - 1)]
    if kind == "fourier":
        f = np.fft.rfft(x)
        g = np.zeros(n // 2 + 1, complex)
        k = min(len(f), len(g))
        g[:k] = f[:k]
        return np.fft.irfft(g, n) * (n / len(x))
    if kind == "lanczos":
        i = np.floor(at).astype(int)[:, None] + np.arange(-2, 4)
        w = np.sinc(at[:, None] - i) * np.sinc((at[:, None] - i) / 3)
        w[(i < 0) | (i >= len(x))] = 0
        return (x[np.clip(i, 0, len(x) - 1)] * w).sum(1) / w.sum(1)
    raise ValueError(f"no resampling named {kind}")


def resampled(old: int, new: int, kind: str = "linear"):
    """resample() as a vectorised function of a column."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: resample(np.asarray(v, float), old, new, kind).tolist(), na_action="ignore")

    return run


def fade(x: np.ndarray) -> np.ndarray:
    """Louder towards the middle (Hamming), then by the mean of its absolute values."""
    y = np.asarray(x, float) * np.hamming(len(x))
    return y / max(np.abs(y).mean(), 1e-12)


def normalised(x: np.ndarray, db: float = -20.0, by: str = "rms") -> np.ndarray:
    """To a level in decibels of its root mean square or of its highest sample."""
    x = np.asarray(x, float)
    level = np.sqrt((x * x).mean()) if by == "rms" else x.max()
    return x * (10 ** (db / 20) / level) if level > 0 else x


def noisy(x: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """With white noise at a signal-to-noise ratio; one seed gives one noise."""
    x = np.asarray(x, float)
    power = (x * x).mean() / 10 ** (snr_db / 10)
    return x + np.random.default_rng(seed).normal(0, np.sqrt(power), len(x))


def read_wav(files: DataFrame) -> DataFrame:
    """path, rate, channels, x (the first channel's 16-bit samples) of binaryFile rows."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2")[:: w.getnchannels()]
                    out.append((path, w.getframerate(), w.getnchannels(), x.astype(int).tolist()))
            yield pd.DataFrame(out, columns=["path", "rate", "channels", "x"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, channels int, x array<int>")


def apply_model(rows: DataFrame, column: str, out: str, kind: str, load, attempts: int = 4):
    """A column of a model's answers: ``load()`` gives, once in each worker's batch loop, a function of a list of inputs.

    A failing call is tried again, then its rows get null, so one bad batch doesn't end the job."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` {kind}"])

    def run(batches):
        model = load()
        for pdf in batches:
            answer = [None] * len(pdf)
            for _ in range(attempts):
                try:
                    answer = list(model(pdf[column].tolist()))
                    break
                except (OSError, TimeoutError):
                    continue
            yield pdf.assign(**{out: answer})

    return rows.mapInPandas(run, schema)
