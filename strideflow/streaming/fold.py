"""The live path's decisions for one session, window by window: guards before and after decoding, with what they remember.

The rules are those of ``strideflow.functions.guards``, which work on columns; here each window needs the answer to the one
before, so they run on small arrays inside the keyed state. A test holds both forms against each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from strideflow.functions.guards import ARTIFACT, BURST_CADENCE, BURST_CONFIDENCE, BURST_PERIODICITY, GAIT, LOCOMOTION, MOVING, RUN_CADENCE, RUN_LOW_CADENCE, RUN_PERIODICITY, STAIRS_CADENCE, STAIRS_PERIODICITY, STATIC, WALKING_CADENCE, WALKING_PERIODICITY

KEEP, LEAST = 90, 20  # rows of metric history, and how many a robust z needs
WEIGHTS, OFFSETS, SCALES = (np.array(v) for v in zip(*ARTIFACT.values(), strict=True))


@dataclass
class Memory:
    """What a session carries from window to window. Rows of ``history`` are the artifact metrics of the last windows."""

    posterior: np.ndarray | None = None
    history: np.ndarray = field(default_factory=lambda: np.zeros((0, len(ARTIFACT))))


def metrics(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """From features of many windows: what the guards ask for, one entry a window. ``artifact`` holds a row of six metrics each."""
    hertz = f["body_mag_autocorr_peak_freq_hz"], f["body_mag_dom_freq_hz"]
    step = np.select([(h >= 0.5) & (h <= 4.0) for h in hertz], hertz, 0.0)
    low = np.maximum(f["body_mag_energy_0p5_4_hz"], 0.0)
    six = {
        "jerk": np.abs(f["jerk_mag_p90"]), "hf": np.maximum(f["body_mag_energy_8_20_hz"], 0.0) / np.maximum(low, 1e-8), "entropy": np.abs(f["body_mag_spectral_entropy"]),
        "gravity": np.abs(f["gravity_angle_stability_std"]), "jitter": np.abs(f["stft_dom_freq_std"]), "periodicity": np.abs(f["body_mag_autocorr_periodicity_ratio"]),
    }
    return {
        "energy": f["body_mag_energy"], "jerk": f["jerk_mag_rms"], "dom": f["body_mag_dom_freq_hz"], "cadence": step * 60,
        "periodicity": np.clip((f["body_mag_autocorr_periodicity_ratio"] - 1) / 2, 0, 1), "artifact": np.stack([six[n] for n in ARTIFACT], axis=1),
    }


def artifact(now: np.ndarray, history: np.ndarray) -> float:
    """The artifact score; with enough history, mostly the weighted rises over it."""
    base = max(0.0, float(WEIGHTS @ np.clip((now - OFFSETS) / SCALES, 0, 2.5)))
    if len(history) < LEAST:
        return base
    centre = np.median(history, axis=0)
    spread = np.maximum(1e-3, 1.4826 * np.median(np.abs(history - centre), axis=0))
    rise = float(WEIGHTS @ np.clip((now - centre) / spread, 0, 4))
    return 0.35 * base + 0.65 * max(0.0, rise)


def unit(p: np.ndarray) -> np.ndarray:
    """Values from 1e-12 to 1, made to sum to 1."""
    clipped = np.clip(p, 1e-12, 1.0)
    return clipped / clipped.sum()


class Guards:
    """Guards over probabilities in the order of ``labels``. A guard that needs a label which isn't there does nothing."""

    def __init__(self, labels: tuple[str, ...], pocket: bool = True):
        self.labels, self.pocket = labels, pocket
        at = {n: k for k, n in enumerate(labels)}
        self.stairs, self.walk, self.run, self.transitions = (at.get(n) for n in ("stairs", "walk", "run", "transitions"))
        self.moving, self.static = np.isin(labels, MOVING), np.isin(labels, STATIC)
        self.two = [k for k in (self.walk, self.run) if k is not None]
        self.gait = self.stairs is not None and len(self.two) == 2

    def _hold(self, p: np.ndarray, limit: float, takers: np.ndarray | list[int], by: np.ndarray | None = None) -> np.ndarray:
        """Stairs at a limit; the rest of its mass goes to the takers in proportion to ``by``."""
        share = (p if by is None else by)[takers]
        share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / len(share))
        new = p.copy()
        new[takers] += (p[self.stairs] - limit) * share
        new[self.stairs] = limit
        return new

    def before(self, p: np.ndarray, energy: float, jerk: float, dom: float, last: np.ndarray | None) -> tuple[np.ndarray, bool]:
        """Emission after the guards that come before decoding, and whether the window is without motion."""
        still = energy < 0.1
        if still:
            rest = np.where(self.moving, 0.0, p)
            rest = rest if rest.sum() > 0 else self.static.astype(float)
            p = rest / rest.sum() if rest.sum() > 0 else p
        if self.stairs is not None and energy <= 0.35 and jerk <= 0.9 and dom <= 0.7 and p[self.stairs] > 0.03:
            p = self._hold(p, 0.03, np.flatnonzero(np.arange(len(p)) != self.stairs))
        if not (self.pocket and self.gait):
            return p, still
        stairs = p[self.stairs]
        smooth = stairs if last is None else 0.6 * stairs + 0.4 * last[self.stairs]
        if energy >= 0.35 and 1.2 <= dom <= 3.2 and smooth >= 0.35 and p[self.two].sum() >= 0.30 and stairs > 0.15:
            p = self._hold(p, 0.15, self.two)
        if 0.30 <= energy <= 1.80 and 1.35 <= dom <= 2.45 and jerk <= 1.20 and p[self.walk] >= 0.18 and p[self.run] <= 0.45 and p[self.stairs] <= 0.45:
            lower = p.copy()
            lower[self.run], lower[self.stairs] = min(p[self.run], 0.22), min(p[self.stairs], 0.18)
            lower[self.walk] += p.sum() - lower.sum()
            p = lower
        if energy > 8 and jerk > 40 and p[self.stairs] > 0.05:
            p = self._hold(p, 0.05, self.two)
        return p, still

    def sure_of_motion(self, last: np.ndarray) -> bool:
        return self.labels[int(last.argmax())] in LOCOMOTION and last.max() >= 0.45

    def _move(self, p: np.ndarray, most: float, taker: int) -> np.ndarray:
        top, new = int(p.argmax()), p.copy()
        moved = min(0.8 * p[top], most)
        new[top] -= moved
        new[taker] += moved
        return new / new.sum()

    def _doubted(self, p: np.ndarray, raw: np.ndarray, cadence: float, rhythm: float) -> int | None:
        """The label that should take mass from the likeliest one of a loose pocket, or None."""
        label, said = self.labels[int(p.argmax())], int(raw.argmax())
        if label == "run" and (cadence < RUN_LOW_CADENCE or (cadence < RUN_CADENCE and rhythm < RUN_PERIODICITY)):
            return self.walk
        if label == "stairs":
            walking = WALKING_CADENCE[0] <= cadence <= WALKING_CADENCE[1] and rhythm >= WALKING_PERIODICITY
            return self.walk if 0 < cadence < STAIRS_CADENCE or rhythm < STAIRS_PERIODICITY or walking else None
        burst = self.labels[said] in GAIT and raw[said] >= BURST_CONFIDENCE and cadence >= BURST_CADENCE and rhythm >= BURST_PERIODICITY
        return said if label == "transitions" and burst else None

    def after(self, p: np.ndarray, raw: np.ndarray, energy: float, cadence: float, rhythm: float, score: float, last: np.ndarray | None) -> tuple[np.ndarray, list[str]]:
        """The posterior after the guards that follow decoding, and the names of those that changed it. ``raw`` is the emission."""
        done = []
        if self.pocket and self.gait and int(p.argmax()) == self.stairs and p[self.stairs] >= 0.70 and raw[self.two].sum() >= 0.15 and raw[self.stairs] <= 0.90:
            p = self._hold(p, 0.55, self.two, raw)
            done.append("stairs-failsafe")
        rose = last is not None and self.static[int(last.argmax())]
        if self.transitions is not None and len(self.two) == 2 and int(p.argmax()) == self.transitions and not rose and energy >= 8:
            p = self._move(p, 0.45, self.run if energy >= 12 else self.walk)
            done.append("locomotion-transitions")
        if self.pocket and score > 1.5:
            share = 0.50 if score >= 2.2 else 0.35
            p = (1 - share) * p + share / len(p)
            done.append("artifact-calibration")
            taker = self._doubted(p, raw, cadence, rhythm) if self.gait else None
            if taker is not None:
                p = self._move(p, 0.35, taker)
                done.append("pocket-sanity")
        return p / p.sum(), done
