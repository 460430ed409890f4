"""Units, text mining, cutting physics and the stability margin as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from spindleflow.functions.risk import clip, safe_log, sigmoid
from spindleflow.schema import struct_of

INCH_M = 0.0254


@dataclass(frozen=True)
class Modal:
    """Two-axis modal parameters; every field may be a number or a Column."""

    mass_x_kg: object = 0.8
    mass_y_kg: object = 0.8
    stiffness_x_n_m: object = 1.55e7
    stiffness_y_n_m: object = 1.25e7
    damping_x_n_s_m: object = 210.0
    damping_y_n_s_m: object = 190.0


@dataclass(frozen=True)
class Tool:
    diameter_m: object = 0.010
    flute_count: object = 4
    overhang_m: object = 0.040
    runout_m: object = 1.0e-6


@dataclass(frozen=True)
class Cut:
    spindle_rpm: object = 9000.0
    feed_per_tooth_m: object = 45.0e-6
    axial_depth_m: object = 0.0006
    radial_depth_m: object = 0.004
    cutting_coeff_t_n_m2: object = 7.0e8
    cutting_coeff_r_n_m2: object = 2.1e8
    immersion_start_rad: float = 0.0
    immersion_end_rad: float = math.pi


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


# ---- units and text -------------------------------------------------------------------------------------------


def feed_from_mm_min(feed_mm_min: Column, rpm: Column, flutes: Column) -> Column:
    """mm/min to metres per tooth, at least 1e-9."""
    return F.greatest(feed_mm_min / 1000.0 / F.greatest(rpm * flutes, F.lit(1e-12)), F.lit(1e-9))


def feed_from_inch_min(feed_ipm: Column, rpm: Column, flutes: Column) -> Column:
    """inch/min to metres per tooth, at least 1e-9; the speed counts as at least 1 rpm."""
    metres = F.coalesce(feed_ipm, F.lit(0.0)) * INCH_M
    speed = F.greatest(F.coalesce(rpm, F.lit(1.0)), F.lit(1.0))
    return F.when(metres <= 0, 1e-9).otherwise(F.greatest(metres / (speed * flutes), F.lit(1e-9)))


def inch_to_m(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0.0)) * INCH_M, F.lit(0.0))


def mm_to_m(value: Column) -> Column:
    return value / 1000.0


def mean_of_numbers(text: Column) -> Column:
    """Mean of all unsigned numbers written in a text; 0 when there is none."""
    numbers = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)),
        lambda s: s.cast("double"),
    )
    size = F.size(numbers)
    summed = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return F.when(size > 0, summed / size).otherwise(0.0)


def flute_count(text: Column) -> Column:
    """Number written before the word flute, at least 1; 4 when the text names none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(\d+)\s*[- ]?\s*flute", 1)
    number = found.try_cast("int")
    return F.when(number.isNull(), 4).otherwise(F.greatest(number, F.lit(1)))


def first_number(*texts: Column, default: float | None = None) -> Column:
    """First of several text columns that parses as a number."""
    return F.coalesce(*[t.try_cast("double") for t in texts], F.lit(default).cast("double"))


# ---- cutting physics ------------------------------------------------------------------------------------------


def tooth_frequency(rpm: Column, flutes) -> Column:
    return rpm * flutes / 60.0


def regenerative_factor(frequency: Column, tooth: Column) -> Column:
    """0.2 + 2 |sin(pi f / ft)|, kept in [0.2, 2.2]."""
    phase = F.lit(2.0 * math.pi) * frequency / F.greatest(tooth, F.lit(1e-12))
    return clip(0.20 + 2.0 * F.abs(F.sin(0.5 * phase)), 0.20, 2.20)


def immersion_arc(start: float, end: float) -> float:
    """Engaged angle; an end at or before the start wraps around."""
    turn = 2.0 * math.pi
    start, end = start % turn, end % turn
    return end - start if end > start else turn - start + end


def directional_factor(cut: Cut, tool: Tool) -> Column:
    immersion = clip(as_column(cut.radial_depth_m) / as_column(tool.diameter_m), 0.02, 1.0)
    arc = min(max(immersion_arc(cut.immersion_start_rad, cut.immersion_end_rad) / (2.0 * math.pi), 0.02), 1.0)
    force = 1.0 + 0.25 * as_column(cut.cutting_coeff_r_n_m2) / as_column(cut.cutting_coeff_t_n_m2)
    return (0.50 + immersion) * (0.65 + arc) * force


def natural_frequencies(modal: Modal) -> tuple[Column, Column]:
    def one(k, m):
        return F.sqrt(as_column(k) / as_column(m)) / (2.0 * math.pi)

    return one(modal.stiffness_x_n_m, modal.mass_x_kg), one(modal.stiffness_y_n_m, modal.mass_y_kg)


def natural_frequency(modal: Modal) -> Column:
    """Mean of the two axis frequencies."""
    x, y = natural_frequencies(modal)
    return 0.5 * (x + y)


def damping_ratio(modal: Modal) -> Column:
    """Mean of the two axis damping ratios."""

    def one(c, k, m):
        return as_column(c) / (2.0 * F.sqrt(as_column(k) * as_column(m)))

    return 0.5 * (
        one(modal.damping_x_n_s_m, modal.stiffness_x_n_m, modal.mass_x_kg)
        + one(modal.damping_y_n_s_m, modal.stiffness_y_n_m, modal.mass_y_kg)
    )


FREQUENCIES = 240
ANGLES = 96


STABILITY_TYPE = struct_of(
    "critical_axial_depth_m:D signed_margin:D limiting_frequency_hz:D tooth_frequency_hz:D"
)


def _solve(c: dict[str, np.ndarray]) -> np.ndarray:
    """Stability of a block of rows: a (rows x 240) frequency grid, all columns shaped (rows, 1)."""
    tooth = c["rpm"] * c["flutes"] / 60.0
    wx = np.sqrt(c["kx"] / c["mx"]) / (2.0 * np.pi)
    wy = np.sqrt(c["ky"] / c["my"]) / (2.0 * np.pi)
    low = np.maximum(5.0, np.maximum(0.65 * np.minimum(wx, wy), 0.60 * tooth))
    high = np.maximum(low + 1.0, np.maximum(1.35 * np.maximum(wx, wy), 1.40 * tooth))
    freq = low + (high - low) * np.arange(FREQUENCIES) / (FREQUENCIES - 1.0)
    w2 = (2.0 * np.pi * freq) ** 2
    ratio = c["kr"] / c["kt"]
    turn = 2.0 * np.pi
    start, end = c["start"] % turn, c["end"] % turn
    arc = np.where(end > start, end - start, turn - start + end)
    phi = start + arc * np.arange(ANGLES) / (ANGLES - 1.0)
    fx = np.abs(ratio * np.sin(phi) - np.cos(phi)).mean(axis=1, keepdims=True)
    fy = np.abs(ratio * np.cos(phi) + np.sin(phi)).mean(axis=1, keepdims=True)
    norm = np.hypot(fx, fy)
    flat = norm <= 1e-12
    dx, dy = np.where(flat, 0.5, fx / np.where(flat, 1.0, norm)), np.where(flat, 0.5, fy / np.where(flat, 1.0, norm))
    compliance = dx / np.sqrt((c["kx"] - c["mx"] * w2) ** 2 + c["cx"] ** 2 * w2)
    compliance += dy / np.sqrt((c["ky"] - c["my"] * w2) ** 2 + c["cy"] ** 2 * w2)
    regen = np.clip(0.20 + 2.0 * np.abs(np.sin(np.pi * freq / np.maximum(tooth, 1e-12))), 0.20, 2.20)
    index = compliance * regen
    best = index.argmax(axis=1)[:, None]
    immersion = np.clip(c["ae"] / c["diameter"], 0.02, 1.0)
    direction = (0.50 + immersion) * (0.65 + np.clip(arc / turn, 0.02, 1.0)) * (1.0 + 0.25 * ratio)
    critical = 0.50 / np.maximum(c["kt"] * direction * np.take_along_axis(index, best, 1), 1e-18)
    critical = np.maximum(1e-5, critical)
    return np.hstack([critical, (critical - c["ap"]) / critical, np.take_along_axis(freq, best, 1), tooth])


_INPUTS = ("rpm", "flutes", "diameter", "ap", "ae", "kt", "kr", "mx", "my", "kx", "ky", "cx", "cy", "start", "end")


def _solve_in_blocks(values: dict[str, np.ndarray]) -> np.ndarray:
    """Blocks that fit the cache. Cuts that differ in the axial depth only share one scan: candidate grids meet the same
    speeds again and again, and the critical depth does not depend on the depth that is cut."""
    count = len(values["rpm"])
    if not count:
        return np.empty((0, 4))
    varying = {n: v[:, 0] for n, v in values.items() if n != "ap" and (v[1:] != v[0]).any()}
    place = pd.DataFrame(varying).groupby(list(varying), sort=False, dropna=False).ngroup().to_numpy() if varying else np.zeros(count, int)
    first = np.unique(place, return_index=True)[1]
    distinct = {n: v[first] for n, v in values.items()}
    solved = np.vstack([_solve({n: v[i : i + 512] for n, v in distinct.items()}) for i in range(0, len(first), 512)])[place]
    solved[:, 1] = (solved[:, 0] - values["ap"][:, 0]) / solved[:, 0]
    return solved


@pandas_udf(STABILITY_TYPE)
def _stability(cuts: pd.DataFrame) -> pd.DataFrame:
    values = {name: cuts[name].to_numpy(float)[:, None] for name in _INPUTS}
    return pd.DataFrame(_solve_in_blocks(values), columns=STABILITY_TYPE.names)


@pandas_udf(T.ArrayType(T.DoubleType()))
def _margins(cuts: pd.DataFrame, overrides: pd.Series) -> pd.Series:
    sizes = overrides.map(len).to_numpy()
    values = {name: np.repeat(cuts[name].to_numpy(float), sizes)[:, None] for name in _INPUTS}
    if sizes.sum():
        values["rpm"] = values["rpm"] * np.concatenate(overrides.to_list()).astype(float)[:, None]
    margins = _solve_in_blocks(values)[:, 1]
    return pd.Series(np.split(margins, np.cumsum(sizes)[:-1]))


def _cut_struct(modal: Modal, tool: Tool, cut: Cut) -> Column:
    values = (
        cut.spindle_rpm, tool.flute_count, tool.diameter_m, cut.axial_depth_m, cut.radial_depth_m,
        cut.cutting_coeff_t_n_m2, cut.cutting_coeff_r_n_m2, modal.mass_x_kg, modal.mass_y_kg, modal.stiffness_x_n_m,
        modal.stiffness_y_n_m, modal.damping_x_n_s_m, modal.damping_y_n_s_m, cut.immersion_start_rad,
        cut.immersion_end_rad,
    )
    return F.struct(*[as_column(v).alias(name) for name, v in zip(_INPUTS, values)])


def stability(modal: Modal, tool: Tool, cut: Cut) -> Column:
    """struct(critical_axial_depth_m, signed_margin, limiting_frequency_hz, tooth_frequency_hz).

    Scans 240 candidate frequencies per row; compliance is the force direction dotted with the two axis receptances,
    instability is compliance times the regenerative factor.  The scan is one vectorised Arrow UDF: the same scan as
    a higher-order function is evaluated element by element and measured some fifty times slower.
    """
    return _stability(_cut_struct(modal, tool, cut))


def margins_at(modal: Modal, tool: Tool, cut: Cut, overrides: Column) -> Column:
    """Signed margins at each spindle override of an array column: candidates stay inside their row."""
    return _margins(_cut_struct(modal, tool, cut), overrides)


# ---- margin calibration ---------------------------------------------------------------------------------------

# Context features of the calibrated margin model, with the defaults of absent columns.
CONTEXT_FEATURES = (
    "raw_margin", "log_spindle_rpm", "log_tooth_frequency_hz", "log_axial_depth_m", "log_radial_depth_m",
    "log_feed_per_tooth_m", "log_cutting_coeff_t_n_m2", "log_cutting_coeff_r_n_m2", "log_modal_frequency_hz",
    "modal_damping_ratio", "stiffness_ratio_xy", "radial_immersion_ratio", "runout_to_feed_ratio",
)
CONTEXT_DEFAULTS = {
    "spindle_rpm": 0.0, "flute_count": 4.0, "tool_diameter_m": 0.010, "feed_per_tooth_m": 45.0e-6,
    "axial_depth_m": 0.0, "radial_depth_m": 0.0, "runout_m": 1.0e-6, "stiffness_x_n_m": 1.55e7,
    "stiffness_y_n_m": 1.25e7, "cutting_coeff_t_n_m2": 7.0e8, "cutting_coeff_r_n_m2": 2.1e8,
    "modal_frequency_hz": 700.0, "modal_damping_ratio": 0.03,
}


def context_features(columns: list[str], raw_margin: Column) -> dict[str, Column]:
    """The 13 context features from whatever columns a table has; absent or NULL ones take their default."""

    def value(name: str, default: Column | None = None) -> Column:
        fallback = F.lit(CONTEXT_DEFAULTS[name]) if default is None else default
        return F.coalesce(F.col(name).cast("double"), fallback) if name in columns else fallback

    rpm, feed, radial = value("spindle_rpm"), value("feed_per_tooth_m"), value("radial_depth_m")
    tiny = F.lit(1e-12)
    result = {
        "raw_margin": raw_margin,
        "log_spindle_rpm": safe_log(rpm),
        "log_tooth_frequency_hz": safe_log(value("tooth_frequency_hz", rpm * value("flute_count") / 60.0)),
        "modal_damping_ratio": value("modal_damping_ratio"),
        "stiffness_ratio_xy": value(
            "stiffness_ratio_xy", value("stiffness_x_n_m") / F.greatest(value("stiffness_y_n_m"), tiny)
        ),
        "radial_immersion_ratio": value(
            "radial_immersion_ratio", radial / F.greatest(value("tool_diameter_m"), tiny)
        ),
        "runout_to_feed_ratio": value("runout_to_feed_ratio", value("runout_m") / F.greatest(feed, tiny)),
    }
    for name in ("axial_depth_m", "radial_depth_m", "feed_per_tooth_m", "cutting_coeff_t_n_m2",
                 "cutting_coeff_r_n_m2", "modal_frequency_hz"):
        result[f"log_{name}"] = safe_log(value(name))
    return {name: result[name] for name in CONTEXT_FEATURES}


@dataclass(frozen=True)
class MarginCalibration:
    """A fitted logistic from margin (raw) or context features to the chatter probability."""

    intercept: float
    slope: float = 0.0
    coefficients: tuple[float, ...] = ()
    feature_names: tuple[str, ...] = ()
    feature_means: tuple[float, ...] = ()
    feature_stds: tuple[float, ...] = ()
    train_brier: float | None = None
    holdout_brier: float | None = None
    margin_uncertainty: float = 0.20
    uncertainty_floor: float = 0.05

    def probability(self, columns: list[str], raw_margin: Column) -> Column:
        if not self.coefficients:
            return sigmoid(self.intercept + self.slope * raw_margin)
        values = context_features(columns, raw_margin)
        logit = F.lit(self.intercept)
        for name, coef, mean, std in zip(self.feature_names, self.coefficients, self.feature_means, self.feature_stds):
            logit = logit + coef * (values[name] - mean) / max(std, 1e-12)
        return sigmoid(logit)

    def boundary_margin(self) -> float | None:
        """Raw margin at probability one half, other features at their means."""
        if self.coefficients and "raw_margin" in self.feature_names:
            i = self.feature_names.index("raw_margin")
            if abs(self.coefficients[i]) <= 1e-12:
                return None
            return self.feature_means[i] - self.intercept * max(self.feature_stds[i], 1e-12) / self.coefficients[i]
        return None if abs(self.slope) <= 1e-12 else -self.intercept / self.slope


def calibrated(calibration: MarginCalibration, columns: list[str], raw_margin: Column) -> dict[str, Column]:
    """Probability, calibrated margin and uncertainty of a raw margin."""
    p = calibration.probability(columns, raw_margin)
    safe = clip(p, 1e-6, 1.0 - 1e-6)
    brier = calibration.holdout_brier if calibration.holdout_brier is not None else calibration.train_brier
    extra = 0.0 if brier is None else min(0.35, brier)
    unsure = 0.08 + 0.35 * 4.0 * p * (1.0 - p) + extra
    return {
        "calibrated_probability": p,
        "calibrated_margin": -calibration.margin_uncertainty * F.log(safe / (1.0 - safe)),
        "calibrated_uncertainty": F.least(F.lit(0.95), F.greatest(F.lit(calibration.uncertainty_floor), unsure)),
    }


def raise_uncertainty(uncertainty: Column, reasons: Column, calibrated_uncertainty: Column) -> dict[str, Column]:
    """Keep the larger uncertainty; a raised one adds its reason once."""
    raised = calibrated_uncertainty > uncertainty
    return {
        "uncertainty": F.when(raised, calibrated_uncertainty).otherwise(uncertainty),
        "reasons": F.when(
            raised, F.array_distinct(F.concat(reasons, F.array(F.lit("calibration_uncertainty"))))
        ).otherwise(reasons),
    }
