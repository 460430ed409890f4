"""Waveform features on array columns: JVM time-domain features, one Arrow UDF for the Welch spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spindleflow.functions.risk import clip, sigmoid, signal_score
from spindleflow.schema import struct_of

SPECTRAL_TYPE = struct_of(
    "tooth_frequency_hz:D tooth_band_energy:D chatter_band_energy:D non_tooth_harmonic_ratio:D"
    " dominant_frequency_hz:D spectral_entropy:D total_energy:D"
)


def total(series: Column, term=lambda x: x) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda acc, x: acc + term(x))


def mean_of(series: Column) -> Column:
    return total(series) / F.size(series)


def magnitude(window: Column) -> Column:
    """Per-sample Euclidean norm of an array of channel vectors (outer = sample)."""
    return F.transform(window, lambda s: F.sqrt(total(s, lambda c: c * c)))


def centred(series: Column) -> Column:
    """Series minus its mean; the mean is taken once per row, not once per element."""
    packed = F.array(F.struct(series.alias("s"), mean_of(series).alias("m")))
    return F.flatten(F.transform(packed, lambda p: F.transform(p["s"], lambda x: x - p["m"])))


def series_of_window(window: Column) -> Column:
    """Multi-channel window to the 1-D series all features use: norm per sample, mean removed."""
    return centred(magnitude(window))


def with_series(df: DataFrame, name: str, series: Column) -> DataFrame:
    """Add the series as a column of its own, computed once per row.

    The one-row ``inline`` keeps the optimizer from copying the expression into every later use, Arrow UDF arguments
    included.
    """
    return df.select("*", F.inline(F.array(F.struct(series.alias(name)))))


def time_features(series: Column) -> Column:
    """struct(rms, peak, crest_factor, kurtosis) of a mean-removed series; kurtosis unbiased, normal = 3."""
    n = F.size(series).cast("double")
    m2 = total(series, lambda x: x * x) / n
    m4 = total(series, lambda x: x * x * x * x) / n
    rms = F.sqrt(m2)
    peak = F.aggregate(series, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    excess = m4 / F.nullif(m2 * m2, F.lit(0.0)) - 3.0
    kurtosis = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6.0) + 3.0)
    return F.struct(
        rms.alias("rms"),
        peak.alias("peak"),
        (peak / F.greatest(rms, F.lit(1e-12))).alias("crest_factor"),
        kurtosis.alias("kurtosis"),
    )


def segment_length(n: int) -> int:
    return min(n, max(64, min(1024, n // 2)))


def _band(freq: np.ndarray, power: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Trapezoid over the masked bins of each row, joined in order across gaps."""
    index = np.arange(freq.shape[1])
    upto = np.maximum.accumulate(np.where(mask, index, -1), axis=1)
    before = np.concatenate([np.full((len(mask), 1), -1), upto[:, :-1]], axis=1)
    pick = np.maximum(before, 0)
    area = 0.5 * (power + np.take_along_axis(power, pick, 1)) * (freq - np.take_along_axis(freq, pick, 1))
    return np.where(mask & (before >= 0), area, 0.0).sum(axis=1)


def _welch(block: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of equal-length rows: periodic Hann, half overlap, segment mean removed."""
    length = segment_length(block.shape[1])
    segments = np.lib.stride_tricks.sliding_window_view(block, length, axis=1)[:, :: length - length // 2]
    taper = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(length) / length)
    spectrum = np.abs(np.fft.rfft((segments - segments.mean(axis=2, keepdims=True)) * taper, axis=2)) ** 2
    power = spectrum.mean(axis=1) / (rate[:, None] * (taper**2).sum())
    power[:, 1 : -1 if length % 2 == 0 else None] *= 2.0
    return np.arange(power.shape[1])[None, :] * rate[:, None] / length, power


@pandas_udf(SPECTRAL_TYPE)
def spectral_features(
    series: pd.Series, rate: pd.Series, rpm: pd.Series, flutes: pd.Series, modal: pd.Series
) -> pd.DataFrame:
    """Spectrum features of each series; ``modal`` NULL means no known natural frequency."""
    out = np.full((len(series), 7), np.nan)
    sizes = series.map(len).to_numpy()
    rates, tooth_all = rate.to_numpy(float), rpm.to_numpy(float) * flutes.to_numpy(float) / 60.0
    modes = modal.to_numpy(float)
    for size in np.unique(sizes[sizes >= 4]):
        rows = np.flatnonzero(sizes == size)
        fs, tooth, mode = rates[rows][:, None], tooth_all[rows][:, None], modes[rows][:, None]
        freq, power = _welch(np.stack(series.iloc[rows].to_list()).astype(float), fs[:, 0])
        energy = np.trapezoid(power, freq, axis=1) + 1e-18
        half = np.maximum(5.0, 0.08 * tooth)
        near = np.zeros(freq.shape, dtype=bool)
        for harmonic in range(1, 7):
            centre = harmonic * tooth
            near |= (centre < freq[:, -1:]) & (np.abs(freq - centre) <= half)
        at_tooth = _band(freq, power, near)
        unknown = np.isnan(mode)
        low = np.where(unknown, np.minimum(np.maximum(1.2 * tooth, 20.0), 0.45 * fs), np.maximum(5.0, 0.75 * mode))
        high = np.where(unknown, 0.45 * fs, np.minimum(0.48 * fs, 1.25 * mode))
        chatter = _band(freq, power, (freq >= low) & (freq <= high) & ~near)
        share = power / (power.sum(axis=1, keepdims=True) + 1e-18)
        entropy = -(share * np.log2(share + 1e-18)).sum(axis=1) / np.log2(power.shape[1])
        out[rows] = np.column_stack(
            [
                tooth[:, 0],
                at_tooth,
                chatter,
                np.maximum(energy - at_tooth, 0.0) / np.maximum(at_tooth, 1e-18),
                freq[np.arange(len(rows)), power.argmax(axis=1)],
                entropy,
                energy,
            ]
        )
    return pd.DataFrame(out, columns=SPECTRAL_TYPE.names)


def growth_target(window_norm: Column, features: Column) -> Column:
    """Signal-only risk with a head-against-tail growth term; ``window_norm`` keeps its mean."""
    size = F.size(window_norm)
    third = F.greatest(F.lit(2), F.floor(size / 3).cast("int"))
    head = F.slice(window_norm, F.lit(1), third)
    tail = F.slice(window_norm, size - third + 1, third)

    def rms(part: Column) -> Column:
        return F.sqrt(total(part, lambda x: x * x) / F.size(part))

    growth = sigmoid((F.log10((rms(tail) + 1e-12) / (rms(head) + 1e-12)) + 0.05) * 3.0)
    signal = signal_score(
        features["chatter_band_energy"],
        features["tooth_band_energy"],
        features["crest_factor"],
        features["spectral_entropy"],
    )
    return clip(0.65 * signal + 0.35 * growth, 0.0, 1.0)
