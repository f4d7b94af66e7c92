"""Motion operators against small fixtures, numpy and each other. Queries are held against DuckDB in test_queries.py."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.functions import guards, insights
from strideflow.functions import signal as S
from strideflow.functions.features import NAMES, compute, window_features
from strideflow.operators import decode, evaluation, recap, timeseries, training
from strideflow.sources import files, recordings
from strideflow.streaming import fold, live

ROW = "session long, seq long, t double, x double, y double, z double"


def series(spark, t, x):
    return spark.createDataFrame([(1, k, float(a), float(b), float(10 * b), float(100 * b)) for k, (a, b) in enumerate(zip(t, x, strict=True))], ROW)


def test_sanitize_sorts_drops_and_anchors(spark):
    rows = series(spark, [2, 1, 1, math.nan, 4], [20, 10, 11, 99, 40])
    got = timeseries.sanitize(rows).orderBy("t").collect()
    assert [(r.t, r.x, r.z) for r in got] == [(0, 10, 1000), (1, 20, 2000), (3, 40, 4000)]


def test_gap_split_and_resample(spark):
    rows = series(spark, [0, 0.02, 0.04, 0.40, 0.42], [1, 2, 3, 4, 5])
    got = timeseries.gap_segments(rows, 0.25).orderBy("t").collect()
    assert [r.segment for r in got] == [0, 0, 0, 1, 1] and got[4].t_segment == pytest.approx(0.02)
    grid = timeseries.resample(series(spark, [0, 0.04], [0, 4]), 0.02).orderBy("i").collect()
    assert [(r.i, r.x, r.y) for r in grid] == [(0, 0, 0), (1, pytest.approx(2), pytest.approx(20)), (2, 4, 40)]
    with pytest.raises(ValueError):
        timeseries.gap_segments(rows, 0)


@pytest.mark.parametrize(("n", "starts"), [(127, []), (128, [0]), (192, [0, 64]), (256, [0, 64, 128])])
def test_window_starts(spark, n, starts):
    rows = timeseries.sliding_windows(series(spark, range(n), range(n)), 128, 64)
    got = rows.groupBy("window_index").agg(F.min("x").alias("x"), F.count("*").alias("n")).orderBy("window_index").collect()
    assert [(r.x, r.n) for r in got] == [(s, 128) for s in starts]


def test_gravity_is_recovered():
    t = np.arange(1000) / 50
    slow = 9.81 + 0.2 * np.sin(2 * np.pi * 0.1 * t)
    gravity = S.butterworth_matrix(1000) @ (slow + 0.5 * np.sin(2 * np.pi * 1.5 * t))
    assert np.abs(gravity - slow)[100:-100].max() < 0.08
    assert S.butterworth_matrix(128) @ np.full(128, 3.0) == pytest.approx(3.0)
    with pytest.raises(ValueError):
        S.butterworth_matrix(128, cutoff=30)


def test_features_are_named_finite_and_ordered(spark):
    assert len(NAMES) == 153 and NAMES[0] == "body_x_mean" and NAMES[-1] == "dwt_high_low_ratio"
    rng = np.random.default_rng(1)
    for acc in (np.zeros((2, 128, 3)), np.full((1, 128, 3), 1e6), rng.normal(size=(3, 128, 3)), rng.normal(size=(1, 2, 3)), np.ones((1, 1, 3))):
        assert all(np.isfinite(v).all() for v in compute(acc).values())
    walk = np.stack([np.sin(2 * np.pi * 1.953125 * np.arange(128) / 50)] * 3, axis=1)[None]
    assert compute(walk)["body_x_dom_freq_hz"][0] == pytest.approx(1.953125)
    assert sum(compute(walk)[f"dwt_{k}_energy"][0] for k in ("d1", "d2", "d3", "d4", "a4")) == pytest.approx(1)
    rows = spark.createDataFrame([(1, [0.0] * 4, [1.0] * 4, [2.0] * 4), (2, [], [], [])], "k long, x array<double>, y array<double>, z array<double>")
    assert window_features(rows, ("k",)).count() == 2


def test_peaks_keep_distance_and_prominence():
    row = np.array([0, 1, 0, 3, 3, 0, 2, 0, 0.1, 0])
    assert S.find_peaks(row, 1, 0.5)[0].tolist() == [1, 3, 6]
    assert S.find_peaks(row, 3, 0.5)[0].tolist() == [3, 6]


def test_guards_keep_mass_and_idle_when_quiet(spark):
    rng = random.Random(0)
    labels = ("walk", "run", "stairs", "sit/lay", "stand", "transitions", "locomotion-other")
    rows = []
    for k in range(300):
        p = [rng.random() ** 3 for _ in labels]
        rows.append((k, *[x / sum(p) for x in p], rng.choice([0.05, 0.3, 1.0, 9.0, 13.0]), rng.choice([0.5, 1.0, 50.0]), rng.random() * 4, rng.random() * 3, rng.random() < 0.7))
    names = [f"p{k}" for k in range(7)]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", energy double, jerk double, dom double, artifact double, pocket boolean")
    m = {k: F.col(k) for k in ("energy", "jerk", "dom", "artifact", "pocket")}
    p = {label: F.col(n) for label, n in zip(labels, names, strict=True)}
    chain = [*guards.PRE_DECODE, guards.calibrate, lambda q, m: guards.stairs_failsafe(q, p, m), lambda q, m: guards.locomotion_transitions(q, F.lit("walk"), m)]
    for guard in chain:
        new = guard(p, m)
        for r in frame.select(sum(new.values(), F.lit(0.0)).alias("s"), F.least(*new.values()).alias("low")).collect():
            assert r.s == pytest.approx(1) and r.low >= -1e-12
    calm = guards.stairs_hallucination(p, m)
    assert frame.where("energy <= 8").where(calm["stairs"] != p["stairs"]).count() == 0


LABELS = ("walk", "run", "stairs", "sit/lay", "stand", "transitions")


@pytest.mark.parametrize(("p", "raw", "sure", "cadence", "rhythm", "artifact", "top", "reason"), [
    ((0.20, 0.65, 0.05, 0.05, 0.05, 0.0), "run", 0.6, 108.0, 0.30, 1.8, "walk", "run-to-walk-low-cadence-artifact"),
    ((0.0, 0.20, 0.08, 0.0, 0.0, 0.72), "run", 0.55, 182.0, 0.5, 1.8, "run", "transitions-to-run-locomotion-burst"),
    ((0.28, 0.0, 0.72, 0.0, 0.0, 0.0), "stairs", 0.7, 110.0, 0.65, 1.9, "walk", "stairs-to-walk-walking-cadence"),
    ((0.20, 0.65, 0.05, 0.05, 0.05, 0.0), "run", 0.6, 108.0, 0.30, 1.5, "run", "none"),
    ((0.0, 0.20, 0.08, 0.0, 0.0, 0.72), None, None, 182.0, 0.5, 1.8, "transitions", "none"),
])
def test_pocket_sanity(spark, p, raw, sure, cadence, rhythm, artifact, top, reason):
    probs, m = dict(zip(LABELS, map(F.lit, p), strict=True)), {"pocket": F.lit(True), "artifact": F.lit(artifact), "cadence": F.lit(cadence), "periodicity": F.lit(rhythm)}
    raw, sure = F.lit(raw).cast("string"), F.lit(sure).cast("double")
    out = guards.pocket_sanity(probs, raw, sure, m)
    row = spark.range(1).select(guards.pocket_reason(probs, raw, sure, m).alias("reason"), guards.top(out).alias("top"), sum(out.values(), F.lit(0.0)).alias("mass")).first()
    assert (row.reason, row.top) == (reason, top) and row.mass == pytest.approx(1)


EIGHT = ("walk", "run", "stairs", "sit", "stand", "lay", "transitions", "locomotion-other")


def guard_row(spark, guard, m, **p):
    """The guard's output on one row of literals; labels that aren't named hold nothing."""
    out = guard({n: F.lit(float(p.get(n.replace("-", "_"), 0.0))) for n in EIGHT}, {"pocket": F.lit(True)} | {k: F.lit(v) for k, v in m.items()})
    return spark.range(1).select(*[c.alias(n) for n, c in out.items()]).first().asDict()


def test_stairs_in_a_moving_pocket_by_smoothed_stairs(spark):
    p, m = {"stairs": 0.70, "walk": 0.22, "run": 0.08}, {"energy": 0.8, "dom": 1.9, "previous_stairs": 0.66}
    got = guard_row(spark, guards.stairs_moving, m, **p)
    assert got["stairs"] == pytest.approx(0.15) and sum(got.values()) == pytest.approx(1) and got["walk"] == pytest.approx(0.22 + 0.55 * 0.22 / 0.30)
    assert guard_row(spark, guards.stairs_moving, m | {"pocket": False}, **p)["stairs"] == pytest.approx(0.70)
    low = {"stairs": 0.40, "walk": 0.50, "run": 0.10}
    assert guard_row(spark, guards.stairs_moving, m | {"previous_stairs": 0.0}, **low)["stairs"] == pytest.approx(0.40)  # 0.24 smoothed
    assert guard_row(spark, guards.stairs_moving, m | {"previous_stairs": None}, **low)["stairs"] == pytest.approx(0.15)  # the present alone
    few = {"stairs": 0.75, "walk": 0.20, "sit": 0.05}
    assert guard_row(spark, guards.stairs_moving, m, **few)["stairs"] == pytest.approx(0.75)  # too little gait


def test_other_guards_on_stated_rows(spark):
    got = guard_row(spark, guards.low_motion, {"energy": 0.02}, run=0.85, sit=0.10, lay=0.05)
    assert got["run"] == got["transitions"] == 0 and got["sit"] + got["lay"] == pytest.approx(1) and got["sit"] > got["lay"]
    assert guard_row(spark, guards.low_motion, {"energy": 0.1}, **{n.replace("-", "_"): 0.125 for n in EIGHT}) == {n: 0.125 for n in EIGHT}
    assert sum(guard_row(spark, guards.low_motion, {"energy": 0.0}, **{n.replace("-", "_"): 0.125 for n in EIGHT}).values()) == pytest.approx(1)
    got = guard_row(spark, guards.stairs_static, {"energy": 0.1, "jerk": 0.2, "dom": 0.2}, stairs=0.6, stand=0.4)
    assert got["stairs"] <= 0.03 + 1e-12 and sum(got.values()) == pytest.approx(1)
    p = {"walk": 0.35, "run": 0.33, "stairs": 0.28, "stand": 0.04}
    got = guard_row(spark, guards.smooth_walk, {"energy": 0.9, "dom": 1.9, "jerk": 0.6}, **p)
    assert got["walk"] > 0.35 and got["run"] < 0.33 and got["stairs"] < 0.28
    assert guard_row(spark, guards.smooth_walk, {"energy": 2.6, "dom": 2.8, "jerk": 2.1}, **p)["walk"] == 0.35
    m = {"energy": 10.0}
    held = guard_row(spark, lambda q, m: guards.locomotion_transitions(q, F.lit("stand"), m), m, transitions=0.9, walk=0.1)
    moved = guard_row(spark, lambda q, m: guards.locomotion_transitions(q, F.lit("walk"), m), m, transitions=0.9, walk=0.1)
    assert held["transitions"] == 0.9 and moved["walk"] == pytest.approx(0.55)
    raw = {n: F.lit({"walk": 0.22, "run": 0.08, "stairs": 0.70}.get(n, 0.0)) for n in EIGHT}
    capped = guard_row(spark, lambda q, m: guards.stairs_failsafe(q, raw, m), {}, stairs=0.995, walk=0.004, run=0.001)
    assert capped["stairs"] == pytest.approx(0.55) and capped["walk"] > 0.004 and capped["run"] > 0.001
    sure = raw | {"stairs": F.lit(0.92)}
    assert guard_row(spark, lambda q, m: guards.stairs_failsafe(q, sure, m), {}, stairs=0.995, walk=0.004, run=0.001)["stairs"] == 0.995


def test_artifact_score_by_its_terms(spark):
    row = {"jerk_mag_p90": 5.0, "body_mag_energy_8_20_hz": 4.0, "body_mag_energy_0p5_4_hz": 1.0, "body_mag_spectral_entropy": 4.8, "gravity_angle_stability_std": 0.55, "body_mag_autocorr_periodicity_ratio": 1.1, "stft_dom_freq_std": 0.7}
    m = guards.artifact_metrics({k: F.lit(v) for k, v in row.items()})
    got = spark.range(1).select(guards.artifact_score(m).alias("score"), m["hf"].alias("hf"), guards.source_suffix(F.lit("continued"), {"stairs-failsafe": F.lit(True), "locomotion-transitions": F.lit(False), "pocket-sanity": F.lit(True)}).alias("source")).first()
    assert got.hf == 4 and got.source == "continued+stairs-failsafe+pocket-sanity"
    assert got.score == pytest.approx(0.30 * 1.75 + 0.30 * 2.5 + 0.15 * 1.6 / 1.2 + 0.15 * 2.25 + 0.10 * 0.52 / 0.22)


def test_low_motion_resets_the_decoder_unless_it_was_still(spark):
    cases = [(True, None, True), (True, [0.1, 0.2], True), (True, [0.9, 0, 0, 0.1, 0, 0], True), (True, [0.1, 0, 0, 0.9, 0, 0], False), (True, [0.4, 0.3, 0.3, 0.0, 0.0, 0.0], False),
             (True, [float("nan")] + [0.2] * 5, True), (True, [0.0] * 6, True), (False, None, False)]
    rows = spark.createDataFrame([(f, None if p is None else [float(x) for x in p], w) for f, p, w in cases], "fired boolean, p array<double>, want boolean")
    for r in rows.select("p", "want", guards.low_motion_reset(F.col("fired"), F.col("p"), LABELS).alias("got")).collect():
        assert r.got == r.want, r.p


def test_reset_modes(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 1.0, 3.0), (1, 2, 9.0, 11.0), (2, 0, 5.0, 7.0)], "session long, seq long, start double, end double")
    runs = lambda *args: [r.run for r in decode.reset_runs(rows, *args).orderBy("session", "seq").collect()]
    assert runs("per-gap", 5.0) == [0, 0, 1, 0] and runs("per-gap", 6.0) == [0, 0, 0, 0] and runs("per-gap") == [0, 0, 0, 0]
    assert runs(" Per-Window ") == [0, 1, 2, 0] and runs("other", 5.0) == [0, 0, 0, 0]
    assert [r.gap_ms for r in decode.reset_runs(rows).orderBy("session", "seq").collect()] == [None, None, 6000.0, None]


def test_decoding_against_numpy(spark):
    rng = np.random.default_rng(3)
    init, trans = np.array([0.2, 0.5, 0.3]), rng.dirichlet(np.ones(3), 3)
    p = rng.dirichlet(np.ones(3), 12)
    rows = spark.createDataFrame([(k // 6, k, float(k), v.tolist()) for k, v in enumerate(p)], "session long, seq long, t double, probs array<double>")
    got = decode.decode(rows, init.tolist(), trans.tolist()).orderBy("seq").collect()
    state = None
    for k, r in enumerate(got):
        state = init if k % 6 == 0 else state @ trans
        state = state * p[k] / (state * p[k]).sum()
        assert r.posterior == pytest.approx(state) and r.label_index == int(state.argmax())


def bout(activity, duration, confidence=0.9, quality=90.0):
    return {"session": 1, "run": 0, "activity": activity, "duration": duration, "confidence_s": confidence * duration, "quality_s": quality * duration, "cadence_s": 0.0, "cadence_d": 0.0, "postures": 0, "folded": 0, "windows": 1}


@pytest.mark.parametrize(("before", "after"), [
    ([("walk", 20), ("run", 2), ("walk", 10)], [("walk", 32)]),
    ([("stairs", 2), ("walk", 20)], [("walk", 22)]),
    ([("sit/lay", 20), ("transitions", 5), ("stand", 9)], [("sit/lay", 20), ("transitions", 5), ("stand", 9)]),
    ([("walk", 20), ("run", 9), ("walk", 10)], [("walk", 20), ("run", 9), ("walk", 10)]),
    ([("walk", 30), ("run", 3), ("sit/lay", 30)], [("walk", 30), ("run", 3), ("sit/lay", 30)]),
    ([("walk", 30), ("locomotion-other", 2), ("sit/lay", 30)], [("walk", 30), ("locomotion-other", 2), ("sit/lay", 30)]),
    ([("walk", 30), ("stairs", 3)], [("walk", 33)]),
    ([("walk", 30), ("locomotion-other", 2)], [("walk", 30), ("locomotion-other", 2)]),
    ([("run", 20), ("walk", 2), ("run", 10)], [("run", 32)]),
    ([("stairs", 20), ("run", 2), ("stairs", 10)], [("stairs", 32)]),
])
def test_denoising(before, after):
    got = recap.denoise_list([bout(a, d) for a, d in before])
    assert [(b["activity"], b["duration"]) for b in got] == after


def test_shaky_motion_between_still_bouts_goes_to_the_longer():
    b = [bout("sit/lay", 20), bout("walk", 2, confidence=0.5), bout("stand", 30)]
    assert [(x["activity"], x["duration"]) for x in recap.denoise_list(b)] == [("sit/lay", 20), ("stand", 32)]


ENTRY = "session long, seq long, t double, status string, activity string, confidence double, quality double, cadence double, posture_change boolean"


def recap_of(spark, *entries):
    """Entries (activity, seconds since the one before, confidence, quality, Hz)."""
    t, rows = 0.0, []
    for k, (activity, gap, sure, quality, hz) in enumerate(entries):
        t += gap
        rows.append((1, k, t, "success", activity, sure, quality, hz, k == 1))
    rows += [(1, 90, t + 0.1, "error", "run", 1.0, 0.0, 3.0, False), (1, 91, t + 0.2, "success", "unknown", 1.0, 0.0, 3.0, False)]
    return recap.history(spark.createDataFrame(rows, ENTRY))


@pytest.mark.parametrize(("activities", "dominant", "bouts"), [
    ("sit/lay walk:.41 sit/lay", "sit/lay", 1), ("sit/lay walk:.41 stand stand", "stand", 2), ("walk stairs:.46 walk", "walk", 1), ("walk walk stairs stairs", "walk", 1),
    ("run walk run", "run", 1), ("stairs run stairs", "stairs", 1),
])
def test_recaps_of_short_sequences(spark, activities, dominant, bouts):
    told = [a.split(":") for a in activities.split()]
    row = recap.summary(recap_of(spark, *[(a, 0.7, float(s[0]) if s else 0.9, 90.0, 1.8) for a, *s in told])).first()
    assert (row.dominant_activity, row.bouts) == (dominant, bouts) and row.noise_bouts_folded >= 1 and row.notes[0].startswith(f"Folded {row.noise_bouts_folded} brief")
    assert row.summary_text.startswith(f"Mostly {dominant} over 2s." if len(told) == 3 else f"Mostly {dominant} over 3s.")


def test_summary_numbers(spark):
    entries = recap_of(spark, *[("walk", 2.0, 0.9, 80.0, 2.0)] * 5, *[("sit/lay", 1.0, 0.9, 50.0, 0.0)] * 4)
    row = recap.summary(entries).first()
    assert row.total_seconds == pytest.approx(13.5) and row.walking_seconds == pytest.approx(9) and row.stationary_seconds == pytest.approx(4.5)  # the last one takes the median step
    assert row.estimated_steps == 18 and row.average_cadence_spm == pytest.approx(120) and row.peak_cadence_spm == pytest.approx(120) and row.estimated_distance_m == pytest.approx(12.6)
    assert row.signal_quality_mean == pytest.approx((5 * 80 + 4 * 50) / 9) and row.signal_quality_min == 50 and row.posture_change_count == 1 and row.noise_bouts_folded == 0
    assert row.notes == [recap.NOTE_SPIKES, recap.NOTE_BLIPS] and row.summary_text == "Mostly walk over 14s. Walking 9s, stationary 4s, about 18 steps at 120 SPM average."


def insight_row(spark, activity, confidence=0.9, artifact=0.1, **changed):
    row = dict.fromkeys(insights.REQUIRED, 0.0) | {"gravity_y_mean": -9.5} | changed
    frame = spark.createDataFrame([(activity, confidence, artifact, *row.values())], "activity string, confidence double, artifact double, " + ", ".join(f"{n} double" for n in row))
    return insights.window_insights(frame, baseline=1.0).first()


def test_window_insights_on_stated_rows(spark):
    walk = insight_row(spark, "walk", body_mag_energy=6.25, body_mag_autocorr_peak_freq_hz=1.75, body_mag_autocorr_periodicity_ratio=2.8, body_mag_interpeak_interval_cv=0.05, stft_dom_freq_std=0.05, jerk_mag_std=0.5, jerk_mag_p90=1.0)
    assert walk.intensity_level == "moderate" and walk.cadence_spm == 105 and walk.cadence_consistency_pct > 75 and walk.prediction_confidence_tier == "high" and walk.phone_orientation == "upright" and not walk.burst_detected
    assert walk.activity_specific_insight == "Steady walking at 105 SPM" and len(walk.applicable_insights) == 15
    stand = insight_row(spark, "stand", gravity_tilt_start_end_delta=math.radians(24), gravity_tilt_abs_z_std=0.1)
    assert stand.posture_change_detected and stand.orientation_change_deg >= 24 - 1e-9 and stand.applicable_insights[-2:] == ["posture_stability_score", "sway_amplitude_deg"] and stand.sway_amplitude_deg == pytest.approx(5.73, abs=0.01)
    assert not insight_row(spark, "transitions", jerk_mag_p90=3.2, body_mag_energy=9.0).burst_detected
    assert insight_row(spark, "run", body_mag_energy=9.0, jerk_mag_p90=3.5, jerk_mag_std=1.6).burst_detected
    assert insight_row(spark, "run", body_mag_energy=9.0, jerk_mag_p90=4.0, jerk_mag_std=2.5).activity_specific_insight.endswith("consider softer landing")
    assert insight_row(spark, "sit/lay", confidence=0.3).activity_specific_insight.startswith("Uncertain") and insight_row(spark, "sit/lay").activity_specific_insight == "Stable seated posture"
    with pytest.raises(ValueError, match="gravity_y_mean"):
        insights.window_insights(spark.range(1).select(*[F.lit(0.0).alias(n) for n in insights.REQUIRED if n != "gravity_y_mean"]))


def test_orientation_and_tiers(spark):
    for g, want in (((0.0, -9.8, 0.0), "upright"), ((0.0, 9.8, 0.0), "upside-down"), ((0.0, 0.0, 9.8), "flat"), ((0.0, 0.0, -9.8), "flat"), ((9.8, 0.0, 0.0), "tilted"), ((1.0, 1.0, 1.0), "tilted"), ((6.0, 6.0, 5.0), "tilted")):
        assert spark.range(1).select(insights.orientation(*map(F.lit, g))).first()[0] == want
    for c, a, want in ((0.85, 0.1, "high"), (0.6, 0.5, "medium"), (0.3, 0.5, "low")):
        assert spark.range(1).select(insights.confidence_tier(F.lit(c), F.lit(a))).first()[0] == want


def test_rolling_recap_counts(spark):
    base = dict.fromkeys(insights.REQUIRED, 0.0) | {"gravity_y_mean": -9.5}
    told = [base | {"body_mag_energy": 0.5}, base | {"body_mag_energy": 4.0}, base | {"body_mag_energy": 9.0, "jerk_mag_p90": 3.5, "jerk_mag_std": 1.6, "gravity_tilt_start_end_delta": 0.5}]
    frame = spark.createDataFrame([(1, k, float(k), a, 0.9, 0.1, *x.values()) for k, (a, x) in enumerate(zip(("stand", "walk", "run"), told, strict=True))], "session long, seq long, t double, activity string, confidence double, artifact double, " + ", ".join(f"{n} double" for n in base))
    row = recap.session_recap(insights.window_insights(frame, baseline=1.0)).first()
    assert (row.still_seconds, row.active_seconds) == pytest.approx((1.28, 2.56)) and (row.transition_count, row.burst_count, row.posture_change_count, row.phone_reposition_count) == (2, 1, 1, 0)
    assert row.most_common_activity == "stand" and [tuple(r) for r in recap.activity_log(frame).orderBy("window_index").collect()] == [(1, 2, "stand", "walk"), (1, 3, "walk", "run")]


def test_transition_start_and_logs(spark):
    rows = spark.createDataFrame([(s, k, float(k), a) for s, labels in (("s1", "001"), ("s2", "101")) for k, a in enumerate(labels)], "session string, seq long, t double, activity string")
    start = {r.activity: r.p for r in evaluation.initial_probs(rows, rows).collect()}
    assert start == {"0": 0.5, "1": 0.5} and sum(math.exp(r.p) for r in evaluation.log_form(evaluation.initial_probs(rows, rows)).collect()) == pytest.approx(1)


def test_signal_gates():
    flat, slope = np.ones((1, 128)), np.arange(128.0)[None]
    assert all(v[0] == 0 for v in S.autocorr_peak(flat)) and not S.ar_coefficients(flat).any() and not S.ar_coefficients(slope[:, :4]).any()
    x = slope - slope.mean()
    ac = np.correlate(x[0], x[0], "full")[127:]
    ac = ac / (ac[0] + 1e-8)
    assert S.autocorr_peak(slope)[3][0] == pytest.approx(ac[12:101].max() / (np.abs(ac[12:101]).mean() + 1e-8))
    still = compute(np.stack([np.zeros(128), np.sin(np.arange(128) / 4), np.zeros(128)], axis=1)[None])
    assert still["body_xy_phase_at_dom_freq"][0] == 0


def test_ingest_reasons_and_live_scores_agree_between_batch_and_stream(spark, tmp_path):
    def message(m, session="s", n=70, **more):
        t0 = m * n * 20.0
        body = {"messageId": m, "sessionId": session, "deviceId": "d", "samples": [{"timestampMs": t0 + 20 * k, "acc": {"x": math.sin(0.25 * (m * n + k)), "y": 0, "z": 9.8}} for k in range(n)]}
        return json.dumps(body | more)

    lines = [message(m, s) for m in range(6) for s in "ab"] + [message(1, "a"), message(9, ""), message(9, n=513), "{", message(9, samples=[{"timestampMs": 1}])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("\n".join(lines))
    raw = spark.read.text(str(tmp_path / "in"))
    parsed = live.parse(raw)
    assert sorted(r.error_reason for r in parsed.where("error_reason is not null").collect()) == ["body", "sample", "sessionId", "too-many-samples"]
    scorer = live.Scorer(("walk", "run", "stand"), live.energy_emission)
    batch = live.score_stream(live.points(live.deduplicate(parsed)), scorer).collect()
    assert len(batch) == 12 and {r.status for r in batch if r.message_id >= 2} == {"success"}
    stream = live.parse(spark.readStream.text(str(tmp_path / "in"))).withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    points = live.points(live.deduplicate(stream))
    q = live.score_stream(points, scorer, ttl_seconds=None).writeStream.format("memory").queryName("snapshots").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)  # ends by itself
    q = live.score_stream(points, scorer).writeStream.format("memory").queryName("expiring").outputMode("append").option("checkpointLocation", str(tmp_path / "e")).start()
    for _ in range(60):  # it looks for expired state for ever, so nothing says that all is read
        if spark.table("expiring").count() >= len(batch):
            break
        time.sleep(1)
    q.stop()
    assert sorted(map(str, spark.table("expiring").collect())) == sorted(map(str, spark.table("snapshots").collect()))
    key = lambda r: (r.session, r.message_id)
    streamed = sorted(spark.table("snapshots").collect(), key=key)
    for a, b in zip(sorted(batch, key=key), streamed, strict=True):
        assert key(a) == key(b) and a.status == b.status and a.label == b.label
    assert live.latest(spark.table("snapshots")).count() == 2


def test_live_decoding_starts_anew_after_motion_and_gaps():
    def played(gap, *parts, labels=("walk", "run", "stand"), emit=live.energy_emission, trans=None):
        scorer = live.Scorer(labels, emit, trans, boundary_gap=gap)
        state, out = live.Session(), []
        for k, (begin, swing) in enumerate(parts):
            t = begin + np.arange(128) * 0.02
            xyz = np.stack([0 * t, 0 * t, 9.8 + swing * np.sin(2 * np.pi * 2 * t)], axis=1)
            out += scorer.messages(state, "s", [(k, (t * 1e9).astype(np.int64), xyz)])
        return out

    # walking leads to standing here, so only a fresh start leaves both still labels alike
    lean = np.array([[0.05, 0.9, 0.05], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])
    told = {"labels": ("walk", "stand", "sit/lay"), "emit": lambda f: np.array([0.8, 0.1, 0.1]), "trans": lean}
    walk, still, later = played(0, (0, 2.5), (6, 0.0), (9, 0.0), **told)
    assert walk["label"] == "walk" and still["posterior"] == pytest.approx([0, 0.5, 0.5], abs=1e-9)
    assert later["posterior"] == pytest.approx([0, 0.5, 0.5], abs=1e-9)
    assert played(0, (0, 2.5), **(told | {"emit": lambda f: np.array([0.0, 0.9, 0.1])}))[0]["label"] == "stand"
    kept = played(0, (0, 2.5), (6, 0.0), **(told | {"emit": lambda f: np.array([0.2, 0.4, 0.4])}))[1]["posterior"]
    before = np.array([0.2, 0.4, 0.4]) @ lean
    assert kept == pytest.approx([0, *(before[1:] / before[1:].sum())], abs=1e-9)
    again = played(0, (50, 2.0))[0]["posterior"]
    assert played(5, (0, 2.5), (50, 2.0))[1]["posterior"] == pytest.approx(again)
    assert played(0, (0, 2.5), (50, 2.0))[1]["posterior"] != pytest.approx(again, abs=1e-9)
    assert played(60, (0, 2.5), (50, 2.0))[1]["posterior"] != pytest.approx(again, abs=1e-9)


def test_readers_and_contract_round_trip(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/data_7_x.txt").write_text("7,Walking,100,1.0,2.0,3.0;\n\nbad line\n7,Walking,x,1,2,3;\n7,Jogging,200,1,2,3;\n")
    assert [(r.subject, r.activity, r.ns) for r in files.semicolon_text(spark, str(tmp_path / "w")).orderBy("ns").collect()] == [("7", "Walking", 100), ("7", "Jogging", 200)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_text("seconds_elapsed,x,y,z,Unnamed: 4\n0.0,1,2,3,9\n0.1,1,b,3,9\n")
    assert files.header_csv(spark, str(tmp_path / "c"), "seconds_elapsed DOUBLE,x DOUBLE,y DOUBLE").where("y is null").count() == 1
    with pytest.raises(ValueError):
        files.header_csv(spark, str(tmp_path / "c"), "missing DOUBLE")
    name = spark.createDataFrame([("front-side-left-running-2026-04-21_19-57-07/A.csv",), ("not-a-valid-session",)], "p string")
    activity, place = files.recording_folder(F.col("p"), ("walking", "running"))
    assert name.select(activity, place).collect()[0][:] == ("running", "front-side-left") and name.select(activity).collect()[1][0] is None
    subjects = spark.createDataFrame([(k,) for k in range(10)], "subject int")
    test = lambda rule, v=(): {r.subject for r in files.holdout(subjects, rule, v).where("split = 'test'").collect()}
    assert test("every-fifth") == {4, 9} and test("list", (4, 9)) == {4, 9} and test("list", (5, 10)) == {4, 9} and test("none") == set()  # as they stand, else one less
    rows = series(spark, range(192), range(192)).withColumns({"split": F.lit("train"), "subject": F.lit(7), "activity": F.lit("walk"), "raw": F.lit("Walking"), "placement": F.lit("pocket")})
    samples = files.contract(timeseries.sliding_windows(rows, 128, 64), "unit", "default")
    assert samples.count() == 256
    files.write_contract(samples, str(tmp_path / "out"))
    windows = files.read_windows(spark, str(tmp_path / "out"))
    assert {(r.global_window_id, r.x[0]) for r in windows.collect()} == {("unit:default:session:1:window:0", 0.0), ("unit:default:session:1:window:1", 64.0)}
    assert spark.read.parquet(str(tmp_path / "out/session_manifest")).first().window_count == 2


def test_labels_placements_and_file_names(spark):
    rows = spark.createDataFrame([(1, "  Walking  Fast "), (2, "other"), (3, "lying"), (4, None)], "id int, raw string")
    got = files.map_labels(rows, {"walking fast": "walk", "lying": "lay", "other": None}).withColumn("activity", files.remap(F.col("activity"), {"lay": "sit/lay"}))
    assert [(r.id, r.activity) for r in got.orderBy("id").collect()] == [(1, "walk"), (3, "sit/lay")]
    place = files.placement(F.lit("front-side-left"), {"front-side-left": "front-side-left-mid"}, {"front-side-left-mid": "front_side_left_mid"})
    hot = files.one_hot(F.lit("shin"), ("front_pocket", "unknown_free_living"))
    subject, activity = files.position_file(F.lit("/r/proband12/data/acc_climbingup_chest.csv"), F.lit("chest"))
    none = files.position_file(F.lit("/r/proband1/data/gyr_x_chest.csv"), F.lit("chest"))[1]
    row = spark.range(1).select(place.alias("p"), subject.alias("s"), activity.alias("a"), none.alias("none"), *[c.alias(n) for n, c in hot.items()]).first()
    assert (row.p, row.s, row.a, row.none, row.placement_front_pocket, row.placement_unknown_free_living) == ("front_side_left_mid", "12", "climbingup", None, 0, 1)
    sides = spark.createDataFrame([(3, "FallingForw"), (4, "Syncope"), (1, "Walking"), (2, "Walking")], "trial int, code string")
    assert [r[0][13:] for r in sides.select(files.trial_side(F.col("trial"), F.col("code"))).collect()] == ["right", "left", "right", "left"]
    subjects = spark.createDataFrame([(k,) for k in range(9)], "subject int")
    assert {r.subject for r in files.holdout(subjects, "list", (4, 9)).where("split = 'test'").collect()} == {3, 8}
    assert {r.subject for r in files.holdout(subjects, "list", (4, 8)).where("split = 'test'").collect()} == {4, 8}
    with pytest.raises(ValueError):
        files.holdout(subjects, "list", (4, 90))
    paths = spark.createDataFrame([(f"a/split={s}/part-{k}",) for s in ("train", "test", "train_only") for k in range(3)] + [("b",)], "path string")
    assert files.pick_files(paths, 2).count() == 6 and files.pick_files(paths, 0).count() == 10
    probs = spark.createDataFrame([(1, 0, 0.0, [0.4, 0.6]), (1, 1, 1.0, [0.45, 0.55])], "session long, seq long, t double, probs array<double>")
    told = lambda name: [r.label_index for r in training.decode_predictions(probs, name, [0.99, 0.01], [[0.98, 0.02], [0.05, 0.95]]).orderBy("seq").collect()]
    assert told("none") == [1, 1] and told("causal-hmm") == [0, 0]
    with pytest.raises(ValueError):
        told("viterbi")


def test_flush_splits_resamples_and_names_segments(spark):
    rows = [(7, k, t, float(k), 0.0, 9.8, "3", "train", "Walking", "pocket") for k, t in enumerate([0.0, 0.02, 0.04, 0.06, 0.5, 0.52, 0.54])] + [(8, 50, 0.0, 1.0, 0.0, 0.0, "3", "train", "swimming", "pocket")]
    frame = spark.createDataFrame(rows, "session long, seq long, t double, x double, y double, z double, subject string, split string, raw string, placement string")
    got = files.flush_sessions(frame, {"walking": "walk"}, 2.0, size=2, hop=1).where("sample_index = 0").orderBy("session", "window_index").collect()
    assert [(r.session, r.window_index, r.activity) for r in got] == [("7:segment:0", 0, "walk"), ("7:segment:0", 1, "walk"), ("7:segment:0", 2, "walk"), ("7:segment:1", 0, "walk"), ("7:segment:1", 1, "walk")]
    assert [r.x for r in got] == pytest.approx([0, 2, 4, 8, 10], abs=1e-9)  # interpolated: 0.52 - 0.5 is not 0.02 to the last bit


def test_named_csv_finds_the_header(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1/a.csv").write_text("id,attr_time,attr_x,attr_y\n1,1000,1,2\n2,1020,3,\n")
    (tmp_path / "b.csv").write_text('some title\n"id","attr_y","attr_time","attr_x"\n1,5,2000,4\nid,attr_y,attr_time,attr_x\n2,x,2020,4\n')
    (tmp_path / "c.csv").write_text("no header\n1,2,3,4\n")
    got = recordings.named_csv(spark, str(tmp_path), ("attr_time", "attr_x", "attr_y"), "attr_time").orderBy("attr_time").collect()
    assert [(r.attr_time, r.attr_x, r.attr_y) for r in got] == [(1000, 1, 2), (2000, 4, 5)]
    rows = recordings.synthetic_time(series(spark, [9, 9, 9], [1, 2, 3])).orderBy("seq").collect()
    assert [r.t for r in rows] == [0, 0.02, 0.04]


def test_forest_learns_and_the_refit_raises_missed_weights(spark):
    rng = random.Random(3)
    rows = [(k, label, rng.gauss(m, 0.3), rng.random(), 1.0) for k in range(200) for label, m in (("walk", 0.0), ("run", 3.0))] + [(500, None, 0.0, 0.0, 1.0), (501, "walk", None, 0.5, 1.0)]
    frame = spark.createDataFrame(rows, "g long, activity string, a double, b double, weight double")
    split = training.split_or_fall_back(frame.withColumn("one", F.lit(1)), ("one", "g"))
    assert 0 < split.where("part = 'tune'").count() < 120
    best = training.search(split, ("a", "b"), [{"numTrees": 3, "maxDepth": 1}, {"numTrees": 5, "maxDepth": 3}], weight="weight")
    assert len(best) == 2 and best[0][0] >= best[1][0] and best[0][0] > 0.95
    model = training.refit_on_misses(frame, ("a", "b"), params={"numTrees": 5, "maxDepth": 3})
    out = training.predict(model, frame.drop("activity")).first()
    assert sorted(training.labels_of(model)) == ["run", "walk"] and sum(out.probs) == pytest.approx(1)
    with pytest.raises(ValueError):
        training.fit_forest(frame.where("activity is null"), ("a", "b"))


def test_two_stage_forests(spark):
    rng = random.Random(5)
    groups = {"locomotion": ["walk", "run"], "static": ["stand", "sit/lay"], "transition": ["transitions"]}
    means = {"walk": (0, 5), "run": (3, 5), "stand": (0, -5), "sit/lay": (3, -5), "transitions": (1.5, 20), "unknown": (0, 0)}
    rows = [(label, rng.gauss(a, 0.3), rng.gauss(b, 0.3)) for label, (a, b) in means.items() for _ in range(60)]
    frame = spark.createDataFrame(rows, "activity string, a double, b double")
    small = {"numTrees": 5, "maxDepth": 3}
    models = training.fit_two_stage(frame, ("a", "b"), groups, params=small)
    assert sorted(models) == ["", "locomotion", "static"]
    for specialist in (None, training.fit_forest(frame.where("activity in ('stand', 'sit/lay')"), ("a", "b"), params=small)):
        out = training.predict_two_stage(models, frame.where("activity <> 'unknown'"), groups, specialist).collect()
        assert len(out) == 300 and sum(r.predicted == r.activity for r in out) > 290
        assert all(sum(r.probs) == pytest.approx(1) and len(r.probs) == 5 for r in out)


def test_candidates_differ_and_repeat_with_the_seed():
    found = training.candidates(20)
    assert found == training.candidates(20) and len({tuple(c.values()) for c in found}) == 20
    assert len(training.candidates(99, {"maxDepth": (1, 2)})) == 2


def test_history_takes_the_new_fields_and_upserts_delete(spark):
    old, new = spark.createDataFrame([(1, 0.5, "x")], "run int, score double, gone string"), spark.createDataFrame([(2, "n", 0.7)], "run int, note string, score double")
    assert [tuple(r) for r in training.evolve(old, new).orderBy("run").collect()] == [(1, None, 0.5), (2, "n", 0.7)]
    held = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 5)], "k int, v string, ver int")
    changes = spark.createDataFrame([(1, None, 2, True), (2, "bb", 1, False), (3, "old", 4, False), (4, None, 1, False)], "k int, v string, ver int, deleted boolean")
    assert sorted(tuple(r) for r in training.upsert(held, changes, "k", "ver").collect()) == [(2, "bb", 1), (3, "c", 5), (4, None, 1)]


def test_denoising_as_a_stream_equals_the_list_and_holds_little():
    rng = np.random.default_rng(5)
    names = ["walk", "run", "stairs", "sit/lay", "stand", "transitions", "locomotion-other"]
    for n in range(400):
        b = []
        for _ in range(n % 40):
            b.append(bout(rng.choice([x for x in names if not b or x != b[-1]["activity"]]), float(rng.choice([0.5, 1.0, 2.0, 3.0, 9.0])), rng.choice([0.5, 0.9])))
        assert list(recap.denoise_stream(iter(b))) == recap.denoise_list(b)
    taken = 0

    def many():
        nonlocal taken
        for k in range(20_000):
            taken = k
            yield bout(("walk", "run", "stand", "sit/lay")[k % 4], 5.0 if k % 4 else 1.0)

    for given, _ in enumerate(recap.denoise_stream(many())):
        assert taken - given < 20_000 * 0.6 and (given > 2 or taken < 20)


def test_sessions_are_read_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n, trans = 300, [[0.8, 0.2], [0.3, 0.7]]
    p = rng.dirichlet(np.ones(2), n)
    rows = spark.createDataFrame([(k % 7 // 5, k, float(k), v.tolist()) for k, v in enumerate(p)], "session long, seq long, t double, probs array<double>")
    names = ("walk", "run", "stand")
    bouts = spark.createDataFrame([(k % 2, k // 2 + 1, names[k // 2 % 3], float(1 + k % 5), 0.5, 50.0, 0.0, 0.0, 0, 0, 1) for k in range(n)], "session long, run long, activity string, duration double, confidence_s double, quality_s double, cadence_s double, cadence_d double, postures long, folded long, windows long")
    points = spark.createDataFrame([("ab"[k % 2], k // 6, k, k * 20_000_000, math.sin(k / 4), 0.0, 9.8) for k in range(n)], "session string, message_id long, seq long, ns long, x double, y double, z double")
    scorer = live.Scorer(names, live.energy_emission)
    found = {}
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            outs = [decode.decode(rows, [0.5, 0.5], trans), recap.denoise(bouts), live.score_stream(points, scorer)]
            found[size] = [sorted(map(str, out.collect())) for out in outs]
            for out in outs:
                plan = out._jdf.queryExecution().optimizedPlan().toString()
                assert "FlatMapGroups" not in plan and "collect_list" not in plan
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["7"] == found["10000"] and len(found["7"][0]) == n and len(found["7"][2]) == 100
    assert len(found["7"][1]) == sum(len(recap.denoise_list([r.asDict() for r in bouts.where(f"session = {s}").orderBy("run").collect()])) for s in (0, 1))


SEVEN = ("walk", "run", "stairs", "locomotion-other", "transitions", "sit/lay", "stand")


def test_guards_in_the_stream_agree_with_those_on_columns(spark):
    rng = np.random.default_rng(4)
    n, k = 600, len(SEVEN)
    draw = lambda *values: [float(v) for v in rng.choice(values, n)]
    raw = np.array([rng.dirichlet(np.full(k, 0.4)) for _ in range(n)])
    raw[:60] = np.eye(k)[rng.integers(0, k, 60)]
    decoded, last = rng.dirichlet(np.full(k, 0.25), n), rng.dirichlet(np.full(k, 0.4), n)
    energy, jerk, dom = draw(0.05, 0.1, 0.2, 0.35, 1.0, 1.8, 8.0, 9.0, 12.0), draw(0.5, 0.9, 1.2, 41.0), draw(0.3, 0.7, 1.2, 1.5, 2.0, 3.2)
    score, cadence, rhythm = draw(0.0, 1.5, 1.6, 2.2), draw(0.0, 80.0, 90.0, 125.0, 140.0), draw(0.1, 0.3, 0.5, 0.6, 0.9)
    names = {label: f"p{j}" for j, label in enumerate(SEVEN)}
    fields = ["id", *names.values(), *(f"d{j}" for j in range(k)), "energy", "jerk", "dom", "artifact", "cadence", "periodicity", "previous_stairs", "previous"]
    data = [(i, *raw[i].tolist(), *decoded[i].tolist(), energy[i], jerk[i], dom[i], score[i], cadence[i], rhythm[i], float(last[i, 2]), SEVEN[int(last[i].argmax())]) for i in range(n)]
    types = ", ".join(f"{c} {'long' if c == 'id' else 'string' if c == 'previous' else 'double'}" for c in fields)
    for pocket in (True, False):
        m = {c: F.col(c) for c in ("energy", "jerk", "dom", "artifact", "cadence", "periodicity", "previous_stairs")} | {"pocket": F.lit(pocket)}
        rows = guards.apply_in_turn(spark.createDataFrame(data, types), names, m)
        later = {label: f"d{j}" for j, label in enumerate(SEVEN)}
        first = {label: F.col(c) for label, c in names.items()}
        rows = guards.apply_in_turn(rows, later, m, (lambda p, m: guards.stairs_failsafe(p, first, m), lambda p, m: guards.locomotion_transitions(p, F.col("previous"), m), guards.calibrate))  # noqa: B023
        rows = rows.withColumns({"said": guards.top(first), "sure": F.greatest(*first.values())})
        rows = guards.apply_pocket_sanity(rows, later, F.col("said"), F.col("sure"), m)
        g, seen = fold.Guards(SEVEN, pocket), set()
        for i, row in enumerate(rows.orderBy("id").collect()):
            emission, _ = g.before(raw[i], energy[i], jerk[i], dom[i], last[i])
            assert emission == pytest.approx([row[c] for c in names.values()], abs=1e-9)
            posterior, done = g.after(decoded[i], emission, energy[i], cadence[i], rhythm[i], score[i], last[i])
            assert posterior == pytest.approx([row[c] for c in later.values()], abs=1e-9) and posterior.sum() == pytest.approx(1)
            assert ("pocket-sanity" in done) == (row["reason"] != "none")
            seen |= set(done)
        assert seen == ({"stairs-failsafe", "locomotion-transitions", "artifact-calibration", "pocket-sanity"} if pocket else {"locomotion-transitions"})


def test_artifact_score_follows_the_column_form_and_the_sessions_past(spark):
    rng = np.random.default_rng(5)
    now, past = rng.uniform(0, 4, (40, 6)), rng.uniform(0, 2, (25, 6))
    rows = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(now)], "id long, " + ", ".join(f"`{c}` double" for c in guards.ARTIFACT))
    column = [r[0] for r in rows.orderBy("id").select(guards.artifact_score({c: F.col(c) for c in guards.ARTIFACT})).collect()]
    assert [fold.artifact(v, past[:19]) for v in now] == pytest.approx(column, abs=1e-9)
    weights = [w for w, *_ in guards.ARTIFACT.values()]
    for v, base in zip(now, column, strict=True):
        rise = 0.0
        for j, w in enumerate(weights):
            centre = np.median(past[:, j])
            rise += w * max(0.0, min(4.0, (v[j] - centre) / max(1e-3, 1.4826 * np.median(np.abs(past[:, j] - centre)))))
        assert fold.artifact(v, past) == pytest.approx(0.35 * base + 0.65 * max(0.0, rise))


def test_messages_scored_together_are_those_scored_one_by_one(monkeypatch):
    rng = np.random.default_rng(6)
    batch, t = [], 0.0
    for k in range(60):
        size = int(rng.integers(0, 40))
        at = t + rng.uniform(0, 0.8, size)
        xyz = np.stack([rng.normal(0, 0.01 if k // 15 % 2 else 3, size), np.sin(12 * at), np.full(size, 9.8)], axis=1)
        if k % 9 == 4 and size:
            xyz[0, 1] = np.nan
        batch.append((k, (at * 1e9).astype(np.int64), xyz))
        t += 0.4
    emit = lambda f: np.stack([np.exp(-np.abs(f["body_mag_energy"] - c)) + 0.05 for c in (3, 9, 5, 7, 1, 0, 0.1)], axis=-1)
    monkeypatch.setattr(live, "RING", 300)
    found = []
    for cut in (60, 7, 1):
        monkeypatch.setattr(live, "AT_ONCE", 16)
        scorer, state, out = live.Scorer(SEVEN, emit), live.Session(), []
        for a in range(0, 60, cut):
            out += scorer.messages(state, "s", batch[a : a + cut])
        found.append(out)
        assert len(state.ns) == 300 and state.last_id == 59 and len(state.memory.history) <= fold.KEEP
    assert str(found[0][-1]["source"]) and {r["source"].split("+")[0] for r in found[0] if r["source"]} >= {"initialized", "continued"}
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert {c: a[c] for c in ("status", "n", "source", "label")} == {c: b[c] for c in ("status", "n", "source", "label")}
            assert (a["posterior"] is None and b["posterior"] is None) or a["posterior"] == pytest.approx(b["posterior"], abs=1e-9)
    plain = live.Scorer(SEVEN, emit, decoder="none").messages(live.Session(), "s", batch)
    assert {r["source"].split("+")[0] for r in plain if r["source"]} == {"disabled"}


def test_viewers_lifetimes_and_json(spark):
    sessions = spark.createDataFrame([("v", "s", 100)], "view_token string, session_id string, expires_ns long")
    asked = spark.createDataFrame([("v", "s", 99), ("v", "s", 100), ("v", "other", 5), ("w", "s", 5), (None, "s", 5)], "view_token string, session_id string, asked_ns long")
    assert sorted((r.session_id, r.asked_ns, r.error_reason) for r in live.viewers(asked, sessions).where("view_token = 'v'").collect()) == [("other", 5, "session-mismatch"), ("s", 99, None), ("s", 100, "expired")]
    assert {r.error_reason for r in live.viewers(asked, sessions).where("view_token is null or view_token = 'w'").collect()} == {"invalid-token"}
    held = spark.createDataFrame([(-5,), (40,), (4000,)], "s int").select(live.lifetime(F.col("s"), 1800)).collect()
    assert [r[0] for r in held] == [1, 40, 1800]
    rows = spark.createDataFrame([("a", 1, None)], "session string, message_id long, label string")
    assert json.loads(live.serialised(rows).collect()[0].json) == {"session": "a", "message_id": 1, "label": None}


def test_every_field_of_a_batch_is_checked_by_its_json_type(spark):
    def said(more, drop=(), **sample):
        one = {"timestampMs": 1, "acc": {"x": 1, "y": 2.5, "z": -3e1}} | sample
        body = {"messageId": 1, "sessionId": "s", "deviceId": "d", "samples": [one]} | more
        return json.dumps({k: v for k, v in body.items() if k not in drop})

    gyro = {"alpha": 1, "beta": 2, "gamma": 3}
    cases = [
        (said({}), None), (said({}, gyro=gyro), None), (said({}, gyro=None), None), (said({}, timestampMs=2.0), None), (said({"sessionId": " "}), None), (said({"samples": []}), None), (said({"source": None}), None),
        ("[1]", "body must be an object."), (None, "body must be an object."), ("{", "body must be an object."),
        *[(said({"messageId": v}), "messageId must be an integer.") for v in (True, 1.0, 1.5, "1", None)], (said({}, ("messageId",)), "messageId must be an integer."),
        *[(said({"sessionId": v}), "sessionId must be a non-empty string.") for v in (5, "", None, True)], (said({"deviceId": {}}), "deviceId must be a non-empty string."),
        (said({"placementLabel": ""}), "placementLabel must be a non-empty string."), (said({"source": 1}), "source must be a non-empty string."),
        (said({"samples": {}}), "samples must be an array."), (said({}, ("samples",)), "samples must be an array."), (said({"samples": [1]}), "samples[0] must be an object."),
        (said({"samples": [None]}), "samples[0] must be an object."), (said({"samples": [None, {"timestampMs": 1}]}), "samples[0] must be an object."), (said({"samples": [1] * 513}), "samples exceeds max allowed per batch (512)."),
        *[(said({}, timestampMs=v), "samples[0].timestampMs must be an integer.") for v in (True, 1.5, "1", None, 10**20)],
        *[(said({}, acc=v), "samples[0].acc must be an object.") for v in (None, 3, [])], (said({}, acc={"x": 1, "y": True, "z": 0}), "samples[0].acc.y must be numeric."), (said({}, acc={"x": 1, "y": 0}), "samples[0].acc.z must be numeric."),
        (said({}, gyro=3), "samples[0].gyro must be an object."), (said({}, gyro={"alpha": 1, "gamma": 2}), "samples[0].gyro.beta must be numeric."), (said({}, gyro=gyro | {"gamma": "1"}), "samples[0].gyro.gamma must be numeric."),
    ]
    rows = live.parse(spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "id int, value string")).orderBy("id").collect()
    for row, (value, text) in zip(rows, cases, strict=True):
        assert row.error_text == text and (row.error_reason is None) == (text is None), value
    got = live.points(live.parse(spark.createDataFrame([(said({}, timestampMs=7.0),)], "value string"))).collect()
    assert [tuple(r) for r in got] == [("s", 1, 0, 7_000_000, 1.0, 2.5, -30.0)]
