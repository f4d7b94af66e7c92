"""Per-window insight scores: plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINE = 0.123
#: The features that insights read, and the names of the insights by activity group.
REQUIRED = (
    "body_mag_energy", "body_mag_dom_freq_hz", "body_mag_autocorr_peak_freq_hz", "body_mag_autocorr_periodicity_ratio", "body_mag_interpeak_interval_cv", "stft_dom_freq_std", "jerk_mag_std", "jerk_mag_p90",
    "dwt_high_low_ratio", "gravity_tilt_start_end_delta", "body_vertical_energy", "gravity_tilt_abs_z_std", "body_mag_coeff_var", "gravity_x_mean", "gravity_y_mean", "gravity_z_mean", "gravity_angle_stability_std",
)
UNIVERSAL = ("intensity_ratio", "intensity_level", "burst_detected", "orientation_change_deg", "posture_change_detected", "phone_orientation", "signal_quality_score", "prediction_confidence_tier", "activity_specific_insight")
BY_GROUP = {
    "locomotion": ("cadence_spm", "cadence_consistency_pct", "smoothness_score", "stride_regularity_score", "vertical_oscillation_mm", "ground_impact_score"),
    "static": ("posture_stability_score", "sway_amplitude_deg"), "transition": ("smoothness_score",), "other": (),
}


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def intensity_ratio(energy: Column, baseline: float = BASELINE) -> Column:
    return F.sqrt(F.greatest(energy, F.lit(0.0)) / baseline)


def intensity_level(ratio: Column) -> Column:
    return F.when(ratio < 1.2, "still").when(ratio < 1.8, "light").when(ratio < 2.8, "moderate").otherwise("high")


def cadence(autocorr_hz: Column, fft_hz: Column) -> Column:
    """Hz: the autocorrelation peak if in 0.5..4, else the spectral peak if in range, else 0."""
    return F.when(autocorr_hz.between(0.5, 4.0), autocorr_hz).when(fft_hz.between(0.5, 4.0), fft_hz).otherwise(0.0)


def periodicity(ratio: Column) -> Column:
    return clamp((ratio - 1) / 2)


def stride_regularity(ratio: Column, cv: Column, dom_std: Column, cadence_hz: Column) -> Column:
    score = 100 * (0.5 * clamp((ratio - 1) / 2) + 0.3 * clamp(1 - cv / 0.5) + 0.2 * clamp(1 - dom_std / 0.75))
    return F.when(cadence_hz > 0, score).otherwise(0.0)


def smoothness(jerk_std: Column, jerk_p90: Column, dwt: Column) -> Column:
    return 100 * (0.45 * clamp(1 - jerk_std / 2.5) + 0.35 * clamp(1 - jerk_p90 / 4) + 0.20 * clamp(1 - (dwt - 0.5) / 2))


def vertical_oscillation(vertical_energy: Column, tilt_std: Column) -> Column:
    return clamp(14 * F.sqrt(F.greatest(vertical_energy, F.lit(0.0))) + 20 * tilt_std, 0, 80)


def ground_impact(jerk_p90: Column, jerk_std: Column, energy: Column) -> Column:
    return 100 * (0.5 * clamp(jerk_p90 / 4) + 0.3 * clamp(jerk_std / 2.5) + 0.2 * clamp(energy / 6))


def posture_stability(energy: Column, gravity_std: Column) -> Column:
    return 100 * (0.4 * clamp(1 - energy / 0.5) + 0.35 * clamp(1 - F.sqrt(F.greatest(energy, F.lit(0.0))) / 0.3) + 0.25 * clamp(1 - gravity_std / 0.2))


def sway_degrees(tilt_std: Column) -> Column:
    return F.abs(tilt_std) * 180 / F.pi()


def orientation(gx: Column, gy: Column, gz: Column) -> Column:
    """How the phone lies, from mean gravity: the strongest axis decides if it is at least 8.5; x alone never does."""
    x, y, z = F.abs(gx), F.abs(gy), F.abs(gz)
    return (
        F.when((z >= 8.5) & (z >= y) & (z >= x), "flat").when((y >= 8.5) & (y >= z) & (y >= x), F.when(gy < 0, "upright").otherwise("upside-down"))
        .otherwise("tilted")
    )


def signal_quality(artifact: Column, dwt: Column, cv: Column) -> Column:
    return 100 * (0.5 * clamp(1 - artifact) + 0.3 * clamp(1 - (dwt - 0.5) / 2) + 0.2 * clamp(1 - cv / 1.5))


def confidence_tier(confidence: Column, artifact: Column) -> Column:
    return F.when((confidence >= 0.8) & (artifact < 1.5), "high").when(confidence >= 0.5, "medium").otherwise("low")


def burst(group: Column, jerk_p90: Column, impact: Column, ratio: Column) -> Column:
    return (group == "locomotion") & (jerk_p90 >= 2.5) & (impact >= 55) & (ratio >= 2.0)


def group_of(activity: Column) -> Column:
    return F.when(activity.isin("walk", "run", "stairs"), "locomotion").when(activity.isin("sit/lay", "stand"), "static").when(activity == "transitions", "transition").otherwise("other")


def posture_changed(tilt_delta: Column, degrees: float = 15.0) -> Column:
    return F.abs(tilt_delta) * 180 / F.pi() >= degrees


def applicable(group: Column) -> Column:
    """Names of the insights that mean something for an activity of this group."""
    own = {g: F.array(*map(F.lit, (*UNIVERSAL, *names))) for g, names in BY_GROUP.items()}
    return F.when(group == "locomotion", own["locomotion"]).when(group == "static", own["static"]).when(group == "transition", own["transition"]).otherwise(own["other"])


def whole(c: Column) -> Column:
    """A number without decimals as text; halves go to the even neighbour."""
    return F.bround(c, 0).cast("long").cast("string")


def text(activity: Column, cadence_spm: Column, impact: Column, stability: Column, regularity: Column, sway: Column, tier: Column) -> Column:
    """One line on the present activity."""
    at = F.concat(F.lit(" at "), whole(cadence_spm), F.lit(" SPM"))
    degrees = F.concat(F.format_string("%.1f", F.bround(sway, 1)), F.lit("\u00b0"))
    say = lambda words, tail: F.concat(F.lit(words), tail)
    return (
        F.when(tier == "low", "Uncertain \u2014 try adjusting phone position")
        .when(activity == "walk", F.when(regularity >= 80, say("Steady walking", at)).when(impact >= 60, say("Walking with firm steps", at)).otherwise(say("Walking", at)))
        .when(activity == "run", F.when(impact >= 70, "High-impact running \u2014 consider softer landing").when(regularity >= 80, say("Smooth running", at)).otherwise(say("Running", at)))
        .when(activity == "stairs", say("Climbing", at))
        .when(activity == "sit/lay", F.when(stability >= 80, "Stable seated posture").when(sway >= 5.0, say("Slight sway while seated \u2014 ", degrees)).otherwise("Relaxed seated posture"))
        .when(activity == "stand", F.when(stability >= 80, "Standing still").when(sway >= 3.0, say("Slight sway while standing \u2014 ", degrees)).otherwise("Standing"))
        .when(activity == "transitions", "Transitioning...").otherwise("Activity detected")
    )


def window_insights(rows: DataFrame, activity: str = "activity", confidence: str = "confidence", artifact: str = "artifact", baseline: float = BASELINE) -> DataFrame:
    """The rows with all insights of their window, from feature columns by name; raises where a feature is missing.

    A null activity counts as unknown, null confidence and artifact as 0.
    """
    if baseline <= 0:
        raise ValueError("the baseline must be positive")
    if missing := sorted(set(REQUIRED) - set(rows.columns)):
        raise ValueError(f"features are missing: {missing}")
    f = {n: F.col(n).cast("double") for n in REQUIRED}
    for n in ("jerk_mag_std", "jerk_mag_p90", "dwt_high_low_ratio", "body_mag_coeff_var", "body_mag_interpeak_interval_cv", "stft_dom_freq_std", "gravity_angle_stability_std"):
        f[n] = F.abs(f[n])
    said, sure, loose = F.coalesce(activity, F.lit("unknown")), F.coalesce(confidence, F.lit(0.0)), F.coalesce(artifact, F.lit(0.0))
    energy, jerk, group = f["body_mag_energy"], f["jerk_mag_p90"], group_of(said)
    hz = cadence(f["body_mag_autocorr_peak_freq_hz"], f["body_mag_dom_freq_hz"])
    own = rows.withColumns({
        "intensity_ratio": intensity_ratio(energy, baseline), "orientation_change_deg": F.abs(f["gravity_tilt_start_end_delta"]) * 180 / F.pi(), "posture_change_detected": posture_changed(f["gravity_tilt_start_end_delta"]),
        "phone_orientation": orientation(f["gravity_x_mean"], f["gravity_y_mean"], f["gravity_z_mean"]), "signal_quality_score": signal_quality(loose, f["dwt_high_low_ratio"], f["body_mag_coeff_var"]),
        "prediction_confidence_tier": confidence_tier(sure, loose), "cadence_spm": hz * 60, "smoothness_score": smoothness(f["jerk_mag_std"], jerk, f["dwt_high_low_ratio"]),
        "stride_regularity_score": stride_regularity(f["body_mag_autocorr_periodicity_ratio"], f["body_mag_interpeak_interval_cv"], f["stft_dom_freq_std"], hz),
        "vertical_oscillation_mm": vertical_oscillation(f["body_vertical_energy"], f["gravity_tilt_abs_z_std"]), "ground_impact_score": ground_impact(jerk, f["jerk_mag_std"], energy),
        "posture_stability_score": posture_stability(energy, f["gravity_angle_stability_std"]), "sway_amplitude_deg": sway_degrees(f["gravity_tilt_abs_z_std"]),
    })
    c = F.col
    return own.withColumns({
        "intensity_level": intensity_level(c("intensity_ratio")), "cadence_consistency_pct": c("stride_regularity_score"), "burst_detected": burst(group, jerk, c("ground_impact_score"), c("intensity_ratio")), "applicable_insights": applicable(group),
        "activity_specific_insight": text(said, c("cadence_spm"), c("ground_impact_score"), c("posture_stability_score"), c("stride_regularity_score"), c("sway_amplitude_deg"), c("prediction_confidence_tier")),
    })
