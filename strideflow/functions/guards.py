"""Guards over label probabilities: each takes and returns a dict of columns, so all stay in generated code.

``m`` holds the window's metrics: energy, jerk, dom, artifact, pocket. A guard that does not fire leaves its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Probs = dict[str, Column]
GAIT, STATIC = ("walk", "run", "stairs"), ("sit/lay", "stand")
LOCOMOTION = (*GAIT, "locomotion-other")
#: Thresholds of the guards.
MOVING = ("walk", "run", "stairs", "locomotion-other", "transitions")


def total(p: Probs, names=None) -> Column:
    return sum((p[n] for n in names or p), F.lit(0.0))


def where(fires: Column, new: Probs, old: Probs) -> Probs:
    return {n: F.when(fires, new[n]).otherwise(old[n]) for n in old}


def normalise(p: Probs) -> Probs:
    clipped = {n: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), c)) for n, c in p.items()}
    return {n: c / total(clipped) for n, c in clipped.items()}


def low_motion(p: Probs, m: dict) -> Probs:
    """Under 0.1 energy only static labels and others keep mass; with none left, static labels share it."""
    rest = total({n: c for n, c in p.items() if n not in MOVING})
    static = [n for n in p if n in STATIC]
    new = {n: F.lit(0.0) if n in MOVING else F.when(rest > 0, F.try_divide(c, rest)).otherwise(F.lit(1.0 / len(static) if n in static else 0.0)) for n, c in p.items()}
    return where(m["energy"] < 0.1, new, p)


def _cap(p: Probs, label: str, limit: float, takers: tuple[str, ...], by: Probs | None = None) -> Probs:
    """Hold a label at a limit; the excess goes to the takers pro rata of ``by``."""
    by = by or p
    excess, mass = p[label] - limit, total(by, takers)
    give = {n: F.when(mass > 0, excess * F.try_divide(by[n], mass)).otherwise(excess / len(takers)) for n in takers}
    return {n: F.lit(limit) if n == label else c + give[n] if n in give else c for n, c in p.items()}


def stairs_static(p: Probs, m: dict) -> Probs:
    fires = (m["energy"] <= 0.35) & (m["jerk"] <= 0.9) & (m["dom"] <= 0.7) & (p["stairs"] > 0.03)
    others = tuple(n for n in p if n != "stairs")
    return where(fires, _cap(p, "stairs", 0.03, others), p)


def stairs_moving(p: Probs, m: dict) -> Probs:
    """Sticky stairs in a moving pocket: 0.6 of the present and 0.4 of the previous posterior's stairs (metric
    ``previous_stairs``; the present alone where it is missing) must reach 0.35, and gait must hold 0.30."""
    stairs = p["stairs"]
    smoothed = 0.6 * stairs + 0.4 * F.coalesce(m["previous_stairs"], stairs) if "previous_stairs" in m else stairs
    fires = m["pocket"] & (m["energy"] >= 0.35) & m["dom"].between(1.2, 3.2) & (smoothed >= 0.35)
    fires = fires & (total(p, ("walk", "run")) >= 0.30) & (stairs > 0.15)
    return where(fires, _cap(p, "stairs", 0.15, ("walk", "run")), p)


def smooth_walk(p: Probs, m: dict) -> Probs:
    fires = m["pocket"] & m["energy"].between(0.30, 1.80) & m["dom"].between(1.35, 2.45) & (m["jerk"] <= 1.20)
    fires = fires & (p["walk"] >= 0.18) & (p["run"] <= 0.45) & (p["stairs"] <= 0.45)
    run, stairs = F.least(p["run"], F.lit(0.22)), F.least(p["stairs"], F.lit(0.18))
    new = p | {"run": run, "stairs": stairs, "walk": p["walk"] + (p["run"] - run) + (p["stairs"] - stairs)}
    return where(fires, new, p)


def stairs_hallucination(p: Probs, m: dict) -> Probs:
    fires = m["pocket"] & (m["energy"] > 8) & (m["jerk"] > 40) & (p["stairs"] > 0.05)
    return where(fires, _cap(p, "stairs", 0.05, ("walk", "run")), p)


def top(p: Probs) -> Column:
    """The most likely label; the first of equals."""
    most = F.greatest(*p.values())
    return F.coalesce(*[F.when(c == most, F.lit(n)) for n, c in p.items()])


def stairs_failsafe(p: Probs, raw: Probs, m: dict) -> Probs:
    fires = m["pocket"] & (top(p) == "stairs") & (p["stairs"] >= 0.70) & (total(raw, ("walk", "run")) >= 0.15) & (raw["stairs"] <= 0.90)
    return where(fires, _cap(p, "stairs", 0.55, ("walk", "run"), raw), p)


def locomotion_transitions(p: Probs, previous: Column, m: dict) -> Probs:
    fires = (top(p) == "transitions") & ~F.coalesce(previous.isin(*STATIC), F.lit(False)) & (m["energy"] >= 8)
    moved = F.least(p["transitions"] * 0.8, F.lit(0.45))
    fast = m["energy"] >= 12
    new = p | {"transitions": p["transitions"] - moved, "run": p["run"] + F.when(fast, moved).otherwise(0.0), "walk": p["walk"] + F.when(fast, 0.0).otherwise(moved)}
    return where(fires, new, p)


def calibrate(p: Probs, m: dict) -> Probs:
    """Blend with uniform where the artifact score is over 1.5."""
    share = F.when(m["artifact"] >= 2.2, 0.50).otherwise(0.35)
    return where(m["pocket"] & (m["artifact"] > 1.5), {n: (1 - share) * c + share / len(p) for n, c in p.items()}, p)


#: Cadences (steps a minute), periodicities and confidence that the pocket check asks for.
RUN_CADENCE, RUN_LOW_CADENCE, RUN_PERIODICITY = 130.0, 95.0, 0.75
STAIRS_CADENCE, STAIRS_PERIODICITY = 85.0, 0.45
WALKING_CADENCE, WALKING_PERIODICITY = (90.0, 130.0), 0.55
BURST_CADENCE, BURST_PERIODICITY, BURST_CONFIDENCE = 120.0, 0.25, 0.40


def pocket_reason(p: Probs, raw_label: Column, raw_confidence: Column, m: dict) -> Column:
    """Why a loose pocket's label is doubted, or ``none``. Metrics ``cadence`` and ``periodicity`` beside the usual ones, and
    ``top``, the likeliest label, where it is known already."""
    cadence, rhythm, label = m["cadence"], m["periodicity"], m.get("top", top(p))
    slow_run = (cadence < RUN_LOW_CADENCE) | ((cadence < RUN_CADENCE) & (rhythm < RUN_PERIODICITY))
    weak_stairs = ((cadence > 0) & (cadence < STAIRS_CADENCE)) | (rhythm < STAIRS_PERIODICITY)
    walking = cadence.between(*WALKING_CADENCE) & (rhythm >= WALKING_PERIODICITY)
    burst = raw_label.isin(*GAIT) & (raw_confidence >= BURST_CONFIDENCE) & (cadence >= BURST_CADENCE) & (rhythm >= BURST_PERIODICITY)
    why = (
        F.when((label == "run") & slow_run, "run-to-walk-low-cadence-artifact").when((label == "stairs") & weak_stairs, "stairs-to-walk-low-periodicity-artifact")
        .when((label == "stairs") & walking, "stairs-to-walk-walking-cadence").when((label == "transitions") & burst, F.concat(F.lit("transitions-to-"), raw_label, F.lit("-locomotion-burst")))
    )
    return F.coalesce(F.when(m["pocket"] & (m["artifact"] > 1.5), why), F.lit("none"))


def pocket_sanity(p: Probs, raw_label: Column, raw_confidence: Column, m: dict) -> Probs:
    """Where ``pocket_reason`` doubts the label, up to 0.35 of its mass goes to walk; that of transitions to the raw label."""
    doubted = pocket_reason(p, raw_label, raw_confidence, m) != "none"
    label = top(p)
    moved = F.least(F.greatest(*p.values()) * 0.8, F.lit(0.35))
    taker = F.when(label == "transitions", raw_label).otherwise("walk")
    new = {n: c - F.when(label == n, moved).otherwise(0.0) + F.when(taker == n, moved).otherwise(0.0) for n, c in p.items()}
    return where(doubted, {n: c / total(new) for n, c in new.items()}, p)


def low_motion_reset(fired: Column, posterior: Column, labels: tuple[str, ...]) -> Column:
    """Start the decoder anew: the low-motion guard fired and the last posterior is missing, bad or sure (0.45) of locomotion."""
    known = usable_posterior(posterior, len(labels))
    first = F.array_position(known, F.array_max(known)).cast("int")
    moving = F.element_at(F.array(*map(F.lit, labels)), first).isin(*LOCOMOTION) & (F.array_max(known) >= 0.45)
    return fired & (known.isNull() | F.coalesce(moving, F.lit(False)))


def usable_posterior(posterior: Column, size: int) -> Column:
    """The posterior with sum 1; null where its length is wrong, a part is null or not finite, or nothing is left to share."""
    bad = F.exists(posterior, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    mass = F.aggregate(posterior, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(posterior) == size) & ~bad & (mass > 0), F.transform(posterior, lambda x: x / mass))


#: Weight, offset and scale of each metric of the artifact score; terms are clipped to 0..2.5.
ARTIFACT = {"jerk": (0.30, 1.5, 2.0), "hf": (0.30, 0.35, 0.40), "entropy": (0.15, 3.2, 1.2), "gravity": (0.15, 0.10, 0.20), "jitter": (0.10, 0.18, 0.22), "periodicity": (-0.35, 1.3, 1.0)}


def artifact_metrics(f: dict[str, Column]) -> dict[str, Column]:
    """The score's six metrics from window features by their names."""
    high, low = (F.greatest(f[f"body_mag_energy_{b}_hz"], F.lit(0.0)) for b in ("8_20", "0p5_4"))
    return {
        "jerk": F.abs(f["jerk_mag_p90"]), "hf": high / F.greatest(low, F.lit(1e-8)), "entropy": F.abs(f["body_mag_spectral_entropy"]), "gravity": F.abs(f["gravity_angle_stability_std"]),
        "jitter": F.abs(f["stft_dom_freq_std"]), "periodicity": F.abs(f["body_mag_autocorr_periodicity_ratio"]),
    }


def artifact_score(metrics: dict[str, Column]) -> Column:
    """How much a window looks like a loose pocket; never negative."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(2.5), c))
    return F.greatest(F.lit(0.0), sum((w * clip((metrics[n] - a) / b) for n, (w, a, b) in ARTIFACT.items()), F.lit(0.0)))


def adaptive_score(base: Column, z: dict[str, Column], enough: Column) -> Column:
    """With enough history: 0.35 of the base score and 0.65 of the weighted rises over the session's own past; else the base."""
    rise = sum((w * F.greatest(F.lit(0.0), z[n]) for n, (w, _, _) in ARTIFACT.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.when(enough, 0.35 * base + 0.65 * F.greatest(F.lit(0.0), rise)).otherwise(base))


def source_suffix(source: Column, corrections: dict[str, Column]) -> Column:
    """The decoder's source with ``+name`` for each correction that was applied, in the order given."""
    return F.concat(source, *[F.when(applied, f"+{name}").otherwise("") for name, applied in corrections.items()])


def apply_pocket_sanity(rows: DataFrame, columns: dict[str, str], raw_label: Column, raw_confidence: Column, m: dict) -> DataFrame:
    """``pocket_sanity`` on probability columns, with ``reason``. Label and reason are columns first, so no expression repeats them."""
    p = {label: F.col(name) for label, name in columns.items()}
    rows = rows.withColumns({"_top": top(p), "_most": F.greatest(*p.values())})
    rows = rows.withColumn("reason", pocket_reason(p, raw_label, raw_confidence, m | {"top": F.col("_top")}))
    moved = F.when(F.col("reason") != "none", F.least(F.col("_most") * 0.8, F.lit(0.35))).otherwise(0.0)
    rows = rows.withColumns({"_moved": moved, "_taker": F.when(F.col("_top") == "transitions", raw_label).otherwise("walk")})
    give, take = F.col("_moved") * -1, F.col("_moved")
    new = {columns[n]: c + F.when(F.col("_top") == n, give).otherwise(0.0) + F.when(F.col("_taker") == n, take).otherwise(0.0) for n, c in p.items()}
    return rows.withColumns(new).drop("_top", "_most", "_moved", "_taker")


#: In this order, before decoding.
PRE_DECODE = (low_motion, stairs_static, stairs_moving, smooth_walk, stairs_hallucination)


def apply_in_turn(rows: DataFrame, columns: dict[str, str], m: dict, chain=PRE_DECODE) -> DataFrame:
    """Rewrite the probability columns guard by guard. One projection each: nested expressions would double with every guard."""
    for guard in chain:
        new = guard({label: F.col(name) for label, name in columns.items()}, m)
        rows = rows.withColumns({columns[label]: c for label, c in new.items()})
    return rows
