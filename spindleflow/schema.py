"""Owned table schemas and the fixed label vocabulary."""

from pyspark.sql import types as T

# Label ids, severity ranks, positive labels, binary cut-off id.
LABELS = ("stable", "transition", "slight", "severe", "unknown")
LABEL_ID = {"stable": 0, "transition": 1, "slight": 2, "severe": 3, "unknown": 4}
SEVERITY = {"unknown": -1, "stable": 0, "transition": 1, "slight": 2, "severe": 3}
POSITIVE_LABELS = ("slight", "severe")
CHATTER_ID = 2
SCHEMA_VERSION = "chatter-window-v5"

EPISODE = ("scenario", "episode")

_KINDS = {"L": T.LongType(), "I": T.IntegerType(), "D": T.DoubleType(), "S": T.StringType(), "B": T.BooleanType()}


def struct_of(spec: str) -> T.StructType:
    """Build a StructType from ``"name:K name:K"`` with K one of L, I, D, S, B."""
    fields = []
    for item in spec.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, _KINDS[kind]))
    return T.StructType(fields)


# Column order of the window table.
WINDOW_SCHEMA = struct_of(
    """
    window_id:L scenario:S episode:L window_index_in_episode:L randomized:B
    spindle_scale:D feed_scale:D axial_depth_scale:D radial_depth_scale:D stiffness_scale:D damping_scale:D
    cutting_coeff_scale:D noise_scale:D start_time_s:D end_time_s:D episode_progress:D
    label:S label_id:I horizon_label:S horizon_label_id:I horizon_s:D
    chatter_within_horizon:B future_chatter_within_horizon:B time_to_chatter_s:D
    risk_chatter_now:D risk_chatter_horizon:D margin_physics:D margin_signal:D uncertainty:D
    spindle_rpm:D feed_per_tooth_m:D axial_depth_m:D radial_depth_m:D
    axial_depth_profile_scale:D cutting_coeff_profile_scale:D cutting_coeff_t_n_m2:D cutting_coeff_r_n_m2:D
    tooth_frequency_hz:D limiting_frequency_hz:D dominant_frequency_hz:D
    rms:D chatter_band_energy:D tooth_band_energy:D non_tooth_harmonic_ratio:D
    dominant_frequency_delta_hz:D rms_delta:D rms_growth_rate:D
    chatter_band_energy_delta:D chatter_band_energy_growth_rate:D
    tooth_band_energy_delta:D tooth_band_energy_growth_rate:D
    non_tooth_harmonic_ratio_delta:D non_tooth_harmonic_ratio_growth_rate:D
    rms_ewma:D chatter_band_energy_ewma:D non_tooth_harmonic_ratio_ewma:D
    """
)

PREDICTION_SCHEMA = struct_of(
    """
    window_id:L scenario:S episode:L start_time_s:D label_id:I label:S horizon_label:S target_label:S
    predicted_label:S predicted_chatter_score:D risk_chatter_now:D future_chatter_within_horizon:B time_to_chatter_s:D
    """
)

INTERVAL_SCHEMA = struct_of("start_time_s:D end_time_s:D label:S")

RUN_METADATA_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("tool", struct_of("diameter_m:D flute_count:I overhang_m:D runout_m:D")),
        T.StructField(
            "process",
            struct_of(
                "axial_depth_m:D radial_depth_m:D feed_per_tooth_m:D spindle_rpm:D"
                " cutting_coeff_t_n_m2:D cutting_coeff_r_n_m2:D"
            ),
        ),
        T.StructField(
            "modal",
            struct_of(
                "mass_x_kg:D mass_y_kg:D stiffness_x_n_m:D stiffness_y_n_m:D damping_x_n_s_m:D damping_y_n_s_m:D"
            ),
        ),
    ]
)
