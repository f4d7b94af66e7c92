"""The 153 features of a three-axis window, computed for whole Arrow batches of windows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideflow.functions import signal as S
from strideflow.functions.signal import EPS, FS

AXES, PAIRS = "xyz", (("x", "y"), ("x", "z"), ("y", "z"))
BANDS = (("0p1_0p5", 0.1, 0.5), ("0p5_1p5", 0.5, 1.5), ("1p5_3", 1.5, 3.0), ("3_6", 3.0, 6.0))


def compute(acc: np.ndarray, fs: float = FS) -> dict[str, np.ndarray]:
    """``acc``: windows x points x 3. Names in the schema's order."""
    n, points, _ = acc.shape
    gravity = np.einsum("ij,njk->nik", S.butterworth_matrix(points, fs=fs), acc)
    body = acc - gravity
    ax = {a: body[:, :, k] for k, a in enumerate(AXES)}
    g = {a: gravity[:, :, k] for k, a in enumerate(AXES)}
    mag = np.sqrt((body**2).sum(2))
    out: dict[str, np.ndarray] = {}
    for a in AXES:
        mu, sd, rms, mad, low, high, skew, kurt = S.moments(ax[a])
        out |= {f"body_{a}_{k}": v for k, v in zip(("mean", "std", "rms", "mad", "min", "max", "zcr", "skew", "kurt"), (mu, sd, rms, mad, low, high, S.zcr(ax[a]), skew, kurt), strict=True)}
    out |= {f"body_corr_{a}{b}": S.corr(ax[a], ax[b]) for a, b in PAIRS}
    out["body_sma"] = np.abs(body).sum(2).mean(1)
    energy = {a: (ax[a] ** 2).mean(1) for a in AXES}
    out |= {f"body_{a}_energy": energy[a] for a in AXES}
    out |= {f"body_energy_{a}{b}_ratio": energy[a] / (energy[b] + EPS) for a, b in PAIRS}
    jerk = np.diff(body, axis=1) * fs if points > 1 else np.zeros((n, 1, 3))
    out |= {f"jerk_{a}_rms": np.sqrt((jerk[:, :, k] ** 2).mean(1)) for k, a in enumerate(AXES)}
    jm = np.sqrt((jerk**2).sum(2))
    q = np.percentile(jm, [25, 75, 90], axis=1)
    out |= {"jerk_mag_mean": jm.mean(1), "jerk_mag_std": jm.std(1), "jerk_mag_rms": np.sqrt((jm**2).mean(1)), "jerk_mag_p90": q[2], "jerk_mag_iqr": q[1] - q[0]}
    out["jerk_mag_dom_freq_hz"] = S.dominant(*S.spectrum(jm, fs))
    freq, p = S.spectrum(mag, fs)
    whole = p.sum(1)
    out |= {"body_mag_dom_freq_hz": S.dominant(freq, p), "body_mag_spectral_entropy": S.spectral_entropy(p), "body_mag_energy": (mag**2).mean(1),
            "body_mag_energy_0p5_4_hz": S.band(freq, p, 0.5, 4), "body_mag_energy_0p1_0p5_hz": S.band(freq, p, 0.1, 0.5)}
    q = np.percentile(mag, [10, 25, 50, 75, 90], axis=1)
    mu, sd, *_, skew, kurt = S.moments(mag)
    out |= {"body_mag_p10": q[0], "body_mag_p50": q[2], "body_mag_p90": q[4], "body_mag_iqr": q[3] - q[1], "body_mag_range": mag.max(1) - mag.min(1), "body_mag_coeff_var": sd / (np.abs(mu) + EPS),
            "body_mag_median_abs_dev": np.median(np.abs(mag - q[2][:, None]), axis=1), "body_mag_skew": skew, "body_mag_kurt": kurt}
    out |= {f"body_mag_autocorr_{k}": v for k, v in zip(("peak", "lag_s", "peak_freq_hz", "periodicity_ratio"), S.autocorr_peak(mag, fs), strict=True)}
    out |= {f"body_mag_{k}": v for k, v in zip(("peak_count", "peak_rate_hz", "peak_prominence_mean", "peak_prominence_std", "interpeak_interval_mean", "interpeak_interval_std", "interpeak_interval_cv"), S.peak_stats(mag, fs).T, strict=True)}
    norm = np.sqrt((gravity**2).sum(2))
    out["gravity_mag_mean"] = norm.mean(1)
    out |= {f"gravity_{a}_mean": g[a].mean(1) for a in AXES} | {f"gravity_{a}_std": g[a].std(1) for a in AXES}
    unit = np.abs(gravity) / (norm[:, :, None] + EPS)
    tilt = np.arccos(np.clip(unit[:, :, 2], 0, 1))
    out |= {"gravity_tilt_abs_z_mean": tilt.mean(1), "gravity_tilt_abs_z_std": tilt.std(1), "gravity_tilt_abs_z_range": tilt.max(1) - tilt.min(1), "gravity_tilt_abs_z_p90": np.percentile(tilt, 90, axis=1)}
    most = unit.max(2)
    share = np.clip(np.abs(gravity) / (np.abs(gravity).sum(2, keepdims=True) + EPS), 1e-12, 1)
    axis_entropy = -(share * np.log(share)).sum(2) / np.log(3)
    out |= {"gravity_max_axis_alignment_mean": most.mean(1), "gravity_max_axis_alignment_std": most.std(1), "gravity_axis_entropy_mean": axis_entropy.mean(1), "gravity_axis_entropy_std": axis_entropy.std(1)}
    centre = gravity.mean(1)
    cosine = np.einsum("npk,nk->np", gravity, centre) / (norm * np.linalg.norm(centre, axis=1)[:, None] + EPS)
    out["gravity_angle_stability_std"] = np.arccos(np.clip(cosine, -1, 1)).std(1)
    up = gravity / (norm[:, :, None] + EPS)
    vertical = (body * up).sum(2)
    horizontal = np.sqrt(((body - vertical[:, :, None] * up) ** 2).sum(2))
    ve, he = (vertical**2).mean(1), (horizontal**2).mean(1)
    out |= {"body_vertical_mean": vertical.mean(1), "body_vertical_std": vertical.std(1), "body_vertical_rms": np.sqrt(ve), "body_vertical_energy": ve,
            "body_horizontal_rms": np.sqrt(he), "body_horizontal_energy": he, "vertical_horizontal_energy_ratio": ve / (he + EPS)}
    half = points // 2
    one, two = (mag[:, :half], mag[:, half:]) if half else (mag, mag)
    out |= {"body_mag_first_half_mean": one.mean(1), "body_mag_second_half_mean": two.mean(1), "body_mag_half_mean_delta": two.mean(1) - one.mean(1),
            "body_mag_first_half_energy": (one**2).mean(1), "body_mag_second_half_energy": (two**2).mean(1), "body_mag_half_energy_ratio": (two**2).mean(1) / ((one**2).mean(1) + EPS)}
    t = np.arange(points) / fs
    tc = t - t.mean()
    out |= {"gravity_tilt_start_end_delta": tilt[:, -1] - tilt[:, 0], "body_mag_linear_trend": (mag * tc).sum(1) / ((tc**2).sum() or 1)}
    spectra = {a: S.spectrum(ax[a], fs)[1] for a in AXES}
    out |= {f"body_{a}_dom_freq_hz": S.dominant(freq, spectra[a]) for a in AXES}
    centroid, spread, roll, flat = S.shape(freq, p)
    out |= {"body_mag_total_power": whole, "body_mag_energy_4_8_hz": S.band(freq, p, 4, 8), "body_mag_energy_8_20_hz": S.band(freq, p, 8, 20), "body_mag_spectral_centroid": centroid}
    out["body_mag_locomotion_ratio"] = out["body_mag_energy_0p5_4_hz"] / (whole + EPS)
    out |= {f"body_mag_rel_energy_{k}": S.band(freq, p, a, b) / (whole + EPS) for k, a, b in BANDS}
    out |= {"body_mag_spectral_spread": spread, "body_mag_spectral_rolloff_85": roll, "body_mag_spectral_flatness": flat}
    for name, x in (*((f"body_{a}", ax[a]) for a in AXES), ("body_mag", mag)):
        out |= {f"{name}_ar_{k + 1}": v for k, v in enumerate(S.ar_coefficients(x).T)}
    for a, b in PAIRS:
        value, lag = S.crosscorr(ax[a], ax[b], fs).T
        out |= {f"body_{a}{b}_crosscorr_max": value, f"body_{a}{b}_crosscorr_lag_s": lag}
    for a, b in PAIRS:
        fa, fb = (np.fft.rfft(x - x.mean(1, keepdims=True), axis=1) for x in (ax[a], ax[b]))
        at = np.maximum(1, np.abs(freq[None, :] - out["body_mag_dom_freq_hz"][:, None]).argmin(1)) if len(freq) > 1 else np.zeros(n, int)
        d = np.angle(fb[np.arange(n), at]) - np.angle(fa[np.arange(n), at])
        moving = (out["body_mag_dom_freq_hz"] > 0) & (ax[a].std(1) >= EPS) & (ax[b].std(1) >= EPS)
        out[f"body_{a}{b}_phase_at_dom_freq"] = np.where(moving, np.arctan2(np.sin(d), np.cos(d)), 0)
    zero = np.zeros(n)
    if points >= 32:
        sf, sp = S.stft_power(mag, fs)
        loco, cad = S.band(sf, sp, 0.5, 4), S.band(sf, sp, 1.4, 2.5)
        out |= {"stft_locomotion_band_mean": loco.mean(1), "stft_locomotion_band_std": loco.std(1), "stft_cadence_band_mean": cad.mean(1), "stft_cadence_band_std": cad.std(1), "stft_dom_freq_std": S.dominant(sf, sp).std(1)}
    else:
        out |= dict.fromkeys(("stft_locomotion_band_mean", "stft_locomotion_band_std", "stft_cadence_band_mean", "stft_cadence_band_std", "stft_dom_freq_std"), zero)
    out |= {f"dwt_{k}": v for k, v in zip(("d1_energy", "d2_energy", "d3_energy", "d4_energy", "a4_energy", "high_low_ratio"), S.dwt_energies(mag).T, strict=True)}
    return {k: np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0) for k, v in out.items()}


NAMES = tuple(compute(np.zeros((1, 128, 3))))


def window_features(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """From ``keys`` and arrays x, y, z of equal length: the keys and one float column per feature. Batches are vectorised by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                series = [part.column(a).to_pylist() for a in AXES]
                lengths = np.array([len(v) for v in series[0]])
                out = np.zeros((part.num_rows, len(NAMES)), np.float32)
                for size in np.unique(lengths[lengths > 0]):
                    at = np.flatnonzero(lengths == size)
                    acc = np.stack([np.array([s[k] for k in at], float) for s in series], axis=2)
                    out[at] = np.stack(list(compute(acc).values()), axis=1)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], *[pa.array(out[:, k]) for k in range(len(NAMES))]], [*keys, *NAMES])

    schema = rows.select(*keys).schema
    for name in NAMES:
        schema = schema.add(name, "float")
    return rows.select(*keys, *AXES).mapInArrow(run, schema)
