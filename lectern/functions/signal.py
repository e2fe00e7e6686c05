"""Signal measures on array columns (samples as doubles)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a frame and of a hop, least samples of each, range of the voice in Hz, level below which a frame is silent, and the
# least height of the autocorrelation's peak.
FRAME_S, LEAST_FRAME, LEAST_HOP = 0.05, 256, 128
LOW_HZ, HIGH_HZ, SILENT_DB, LEAST_CONFIDENCE = 70, 350, -38.0, 0.25
LEAST_VOICED = 4
#: Frames transformed together.
_TOGETHER = 1024


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x)))


def decibels(level: Column, floor: float = 1e-9) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(floor)))


def share_above(samples: Column, bound: float) -> Column:
    return F.size(F.filter(samples, lambda x: F.abs(x) >= bound)) / F.size(samples)


def frames(samples: Column, length: int) -> Column:
    """The samples in frames of `length`, the last one as long as it is."""
    starts = F.sequence(F.lit(1), F.size(samples), F.lit(length))
    return F.transform(starts, lambda at: F.slice(samples, at, length))


def limit(samples: Column, most: float) -> Column:
    """Scaled down where the peak is above `most`."""
    top = peak(samples)
    return F.transform(samples, lambda x: F.when(top > most, x * most / top).otherwise(x))


def fade(samples: Column, ramp: int) -> Column:
    """Linear ramps at both ends, from and to zero."""
    n = F.size(samples)
    return F.transform(samples, lambda x, i: x * F.least(F.lit(1.0), i / F.lit(ramp), (n - 1 - i) / F.lit(ramp)))


def trim(samples: Column, bound: float) -> Column:
    """Without the ends below `bound`; empty if all are."""
    loud = F.transform(samples, lambda x: F.abs(x) >= bound)
    first = F.array_position(loud, F.lit(True)).cast("int")
    last = (F.size(samples) + 1 - F.array_position(F.reverse(loud), F.lit(True))).cast("int")
    return F.when(first > 0, F.slice(samples, first, last - first + 1)).otherwise(F.slice(samples, 1, 0))


def crossfade(left: Column, right: Column, overlap: int) -> Column:
    """The end of one over the start of the other, linearly."""
    tail, head = F.slice(left, F.size(left) - overlap + 1, overlap), F.slice(right, 1, overlap)
    mixed = F.transform(F.arrays_zip(tail.alias("a"), head.alias("b")), lambda p, i: p["a"] * (1 - (i + 1) / F.lit(overlap + 1)) + p["b"] * ((i + 1) / F.lit(overlap + 1)))
    return F.concat(F.slice(left, F.lit(1), F.size(left) - overlap), mixed, F.slice(right, F.lit(overlap + 1), F.size(right)))


def frame_pitch(samples: np.ndarray, rate: int) -> np.ndarray:
    """f0 in Hz of each whole frame of the samples; NaN where it is silent or has no clear pitch within the voice's range. The peak of
    the windowed frame's autocorrelation, which is the inverse transform of its power spectrum."""
    frame, hop = max(LEAST_FRAME, int(rate * FRAME_S)), max(LEAST_HOP, int(rate * FRAME_S))
    least = max(1, int(rate / HIGH_HZ))
    most = min(max(least + 1, int(rate / LOW_HZ)), frame - 1)
    n = max(0, (len(samples) - frame) // hop + 1)
    out = np.full(n, np.nan)
    if most <= least:
        return out
    size = 1 << (2 * frame - 1).bit_length()
    for at in range(0, n, _TOGETHER):
        k = np.arange(at, min(at + _TOGETHER, n))
        x = samples[k[:, None] * hop + np.arange(frame)].astype(np.float64)
        loud = 10 * np.log10(np.maximum((x * x).mean(axis=1) + 1e-12, 1e-24)) >= SILENT_DB
        x = (x - x.mean(axis=1, keepdims=True)) * np.hanning(frame)
        ac = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[:, :frame]
        lag = least + ac[:, least : most + 1].argmax(axis=1)
        height, hz = ac[np.arange(len(k)), lag], rate / lag
        with np.errstate(invalid="ignore", divide="ignore"):
            clear = loud & (ac[:, 0] > 1e-12) & (height / ac[:, 0] >= LEAST_CONFIDENCE) & (hz >= LOW_HZ) & (hz <= HIGH_HZ)
        out[k[clear]] = hz[clear]
    return out


def pitch(rate: int) -> Callable[[Column], Column]:
    """A function of an array of samples: f0 of each frame, null where there is none; null for null samples. In Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        found = (None if x is None else frame_pitch(np.asarray(x, np.float64), rate) for x in samples)
        return pd.Series([None if f is None else [None if np.isnan(v) else float(v) for v in f] for f in found], dtype=object)

    return run


def semitone_spread(f0: Column) -> Column:
    """Population deviation of an array of pitches in semitones about their median; null below LEAST_VOICED pitches."""
    voiced = F.array_sort(F.filter(f0, lambda x: x.isNotNull()))
    n = F.size(voiced)
    median = (F.get(voiced, F.floor((n - 1) / 2).cast("int")) + F.get(voiced, F.floor(n / 2).cast("int"))) / 2
    # bound as lambda variables, so that nothing is sorted once a pitch
    tones = F.transform(F.array(F.struct(voiced.alias("v"), median.alias("m"))), lambda x: F.transform(x["v"], lambda v: 12 * F.log2(v / x["m"])))[0]
    sums = F.aggregate(tones, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("n")), lambda a, t: F.struct((a["s"] + t).alias("s"), (a["q"] + t * t).alias("q"), (a["n"] + 1).alias("n")))
    spread = F.transform(F.array(sums), lambda a: F.sqrt(F.greatest(F.lit(0.0), a["q"] / a["n"] - F.pow(a["s"] / a["n"], 2))))[0]
    return F.when(n >= LEAST_VOICED, spread)
