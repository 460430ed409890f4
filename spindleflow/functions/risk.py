"""Hybrid physics and signal risk as column expressions."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindleflow.functions.labels import risk_to_label


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(x, low), high)


def safe_log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-18)))


def safe_log10(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1e-18)))


@dataclass(frozen=True)
class RiskInputs:
    """Columns the risk blend reads."""

    chatter_band_energy: Column
    tooth_band_energy: Column
    crest_factor: Column
    spectral_entropy: Column
    margin: Column
    sensor_healthy: Column | None = None
    in_cut: Column | None = None
    margin_uncertainty: float = 0.20


def signal_score(chatter: Column, tooth: Column, crest: Column, entropy: Column) -> Column:
    """Band-energy ratio, crest factor and entropy, weighted .55 / .25 / .20."""
    ratio = chatter / F.greatest(tooth, F.lit(1e-18))
    blended = (
        F.lit(0.55) * sigmoid((F.log10(ratio + 1e-12) + 0.4) * 2.0)
        + F.lit(0.25) * sigmoid((crest - 4.0) / 1.5)
        + F.lit(0.20) * sigmoid((entropy - 0.55) * 6.0)
    )
    return F.least(F.lit(1.0), blended)


def risk_struct(source: RiskInputs) -> Column:
    """struct(risk_chatter_now, risk_chatter_horizon, margin_signal, uncertainty, label, reasons)."""
    width = max(source.margin_uncertainty, 1e-6)
    physics = sigmoid(-source.margin / width)
    signal = signal_score(
        source.chatter_band_energy, source.tooth_band_energy, source.crest_factor, source.spectral_entropy
    )
    now = clip(0.55 * physics + 0.45 * signal, 0.0, 1.0)
    ahead = F.least(F.lit(1.0), F.greatest(now, 0.75 * physics + 0.25 * signal))
    unsure = F.least(F.lit(0.95), 0.12 + 0.55 * F.exp(-F.abs(source.margin) / width))
    reasons = F.array_compact(
        F.array(
            F.when(source.margin < 0, F.lit("negative_physics_margin")),
            F.when(signal > 0.55, F.lit("chatter_band_energy")),
            F.when(physics > 0.70, F.lit("near_stability_boundary")),
            F.when(source.crest_factor > 5.0, F.lit("impulsive_vibration")),
        )
    )
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("nominal"))).otherwise(reasons)
    healthy = source.sensor_healthy if source.sensor_healthy is not None else F.lit(True)
    in_cut = source.in_cut if source.in_cut is not None else F.lit(True)
    usable = healthy & in_cut
    blocked = F.array(F.when(~healthy, F.lit("sensor_unhealthy")).otherwise(F.lit("not_in_cut")))
    return F.struct(
        F.when(usable, now).otherwise(0.5).alias("risk_chatter_now"),
        F.when(usable, ahead).otherwise(0.5).alias("risk_chatter_horizon"),
        F.when(usable, 1.0 - 2.0 * signal).otherwise(0.0).alias("margin_signal"),
        F.when(usable, unsure).otherwise(0.95).alias("uncertainty"),
        F.when(usable, risk_to_label(now)).otherwise("unknown").alias("label"),
        F.when(usable, reasons).otherwise(blocked).alias("reasons"),
    )
