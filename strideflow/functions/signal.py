"""Signal features. Column expressions over ``array<double>`` where built-ins suffice; numpy kernels, applied to Arrow batches of
whole windows, for filters, peaks, regressions and wavelets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FS = 50.0
EPS = 1e-8


# --- expressions -------------------------------------------------------------------------------


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def centred(v: Column) -> Column:
    return F.transform(v, lambda x: x - mean(v))


def power(v: Column, k: int) -> Column:
    """Mean of the k-th power."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(float(k)))) / F.size(v)


# --- numpy kernels over (rows, points) ---------------------------------------------------------


def butterworth_matrix(n: int, cutoff: float = 0.3, fs: float = FS, order: int = 3) -> np.ndarray:
    """Zero-phase low-pass of fixed length as a matrix: one section after another, forwards and backwards over an odd extension."""
    if not (0 < cutoff < fs / 2) or order < 1 or fs <= 0:
        raise ValueError("cutoff must lie between 0 and half the rate, order at least 1")
    pad = 3 * (2 * ((order + 1) // 2) + 1 - order % 2)
    if n <= pad:
        return np.full((n, n), 1.0 / max(n, 1))
    warped = 2 * fs * np.tan(np.pi * cutoff / fs)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (2 * fs + poles) / (2 * fs - poles)
    sections = []
    for p in z[z.imag > 1e-12]:
        a = np.array([1.0, -2 * p.real, abs(p) ** 2])
        sections.append((np.array([1.0, 2.0, 1.0]) * a.sum() / 4, a))
    for p in z[np.abs(z.imag) <= 1e-12].real:
        sections.append((np.array([1.0, 1.0, 0.0]) * (1 - p) / 2, np.array([1.0, -p, 0.0])))
    x = np.eye(n)
    ext = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            gain = b.sum() / a.sum()
            first = ext[0].copy()
            z1, z2 = (gain - b[0]) * first, (b[2] - a[2] * gain) * first
            out = np.empty_like(ext)
            for k in range(len(ext)):
                out[k] = b[0] * ext[k] + z1
                z1 = b[1] * ext[k] - a[1] * out[k] + z2
                z2 = b[2] * ext[k] - a[2] * out[k]
            ext = out
        ext = ext[::-1]
    return ext[pad : pad + n]


#: Scaling filter of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])


def dwt_energies(x: np.ndarray, levels: int = 4) -> np.ndarray:
    """Shares of energy in D1..D4 and A4, then (D1+D2+D3)/(D4+A4); zeros for silent rows."""
    low, high = DB4, DB4[::-1] * np.where(np.arange(8) % 2, 1, -1)
    energy, a = [], x
    for _ in range(levels):
        ext = np.pad(a, ((0, 0), (7, 7)), mode="symmetric")
        blocks = np.lib.stride_tricks.sliding_window_view(ext, 8, axis=1)[:, 1::2]
        a, d = blocks @ low[::-1], blocks @ high[::-1]
        energy.append((d**2).sum(1))
    energy.append((a**2).sum(1))
    e = np.stack(energy, axis=1)
    whole = e.sum(1, keepdims=True)
    share = np.divide(e, whole, out=np.zeros_like(e), where=whole > 0)
    ratio = share[:, :3].sum(1) / (share[:, 3] + share[:, 4] + EPS)
    return np.concatenate([share, np.where(whole[:, 0] > 0, ratio, 0)[:, None]], axis=1)


def spectrum(x: np.ndarray, fs: float = FS) -> tuple[np.ndarray, np.ndarray]:
    x = x - x.mean(1, keepdims=True)
    return np.fft.rfftfreq(x.shape[1], 1 / fs), np.abs(np.fft.rfft(x, axis=1)) ** 2


def band(freq: np.ndarray, p: np.ndarray, low: float, high: float) -> np.ndarray:
    return p[..., (freq >= low) & (freq <= high)].sum(-1)


def dominant(freq: np.ndarray, p: np.ndarray) -> np.ndarray:
    return freq[1:][p[..., 1:].argmax(-1)] if p.shape[-1] > 1 else np.zeros(p.shape[:-1])


def spectral_entropy(p: np.ndarray) -> np.ndarray:
    whole = p.sum(1, keepdims=True)
    q = np.divide(p, whole, out=np.zeros_like(p), where=whole > 0)
    bins = (q > 0).sum(1)
    h = -np.where(q > 0, q * np.log(np.where(q > 0, q, 1)), 0).sum(1)
    return np.where(bins > 1, h / np.log(np.maximum(bins, 2)), 0)


def shape(freq: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Centroid, spread, 85 % rolloff, flatness."""
    whole = p.sum(1)
    safe = np.where(whole > 0, whole, 1)
    centre = (p * freq).sum(1) / safe
    spread = np.sqrt((p * (freq - centre[:, None]) ** 2).sum(1) / safe)
    roll = freq[(np.cumsum(p, axis=1) >= 0.85 * whole[:, None]).argmax(1)]
    some = p > 0
    count = np.maximum(some.sum(1), 1)
    flat = np.exp(np.where(some, np.log(np.where(some, p, 1)), 0).sum(1) / count) / (p.sum(1) / count + EPS)
    live = whole > 0
    return [np.where(live, v, 0) for v in (centre, spread, roll, flat)]


def autocorr_peak(x: np.ndarray, fs: float = FS) -> list[np.ndarray]:
    """Peak, its lag in seconds and Hz, and its ratio to the mean absolute autocorrelation of the lags searched."""
    n = x.shape[1]
    x = x - x.mean(1, keepdims=True)
    low, high = int(fs / 4), min(n - 1, int(fs / 0.5))
    if n < 3 or high <= low:
        return [np.zeros(len(x))] * 4
    f = np.fft.rfft(x, 2 * n, axis=1)
    ac = np.fft.irfft(np.abs(f) ** 2, 2 * n, axis=1)[:, :n]
    ac = ac / (ac[:, :1] + EPS)
    part = ac[:, low : high + 1]
    at = part.argmax(1)
    peak, lag = part[np.arange(len(x)), at], (at + low) / fs
    live = x.std(1) >= EPS
    return [np.where(live, v, 0) for v in (peak, lag, 1 / lag, peak / (np.abs(part).mean(1) + EPS))]


def find_peaks(row: np.ndarray, distance: int, prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima (middle of plateaus), higher ones first by distance, then by prominence."""
    change = np.flatnonzero(np.diff(row)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(row)]])
    peaks = [(a + b - 1) // 2 for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if 0 < k < len(starts) - 1 and row[a - 1] < row[a] > row[b]]
    keep = np.ones(len(peaks), bool)
    for k in sorted(range(len(peaks)), key=lambda k: (row[peaks[k]], k), reverse=True):
        if keep[k]:
            for j in range(len(peaks)):
                if j != k and abs(peaks[j] - peaks[k]) < distance:
                    keep[j] = False
    found, depth = [], []
    for p in (peaks[k] for k in np.flatnonzero(keep)):
        higher = np.flatnonzero(row > row[p])
        left, right = higher[higher < p], higher[higher > p]
        a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(row))
        d = row[p] - max(row[a : p + 1].min(), row[p:b].min())
        if d >= prominence:
            found.append(p)
            depth.append(d)
    return np.array(found, int), np.array(depth)


def peak_stats(x: np.ndarray, fs: float = FS) -> np.ndarray:
    out = np.zeros((len(x), 7))
    for k, row in enumerate(x):
        if row.std() < EPS:
            continue
        at, depth = find_peaks(row, max(1, int(0.25 * fs)), 0.25 * row.std())
        gap = np.diff(at) / fs
        out[k] = [len(at), len(at) / (len(row) / fs), depth.mean() if len(at) else 0, depth.std() if len(at) else 0,
                  gap.mean() if len(gap) else 0, gap.std() if len(gap) else 0, gap.std() / (gap.mean() + EPS) if len(gap) else 0]
    return out


def ar_coefficients(x: np.ndarray, order: int = 4) -> np.ndarray:
    out = np.zeros((len(x), order))
    x = x - x.mean(1, keepdims=True)
    if x.shape[1] <= order:
        return out
    for k in np.flatnonzero(x.std(1) >= EPS):
        row = x[k]
        lags = np.stack([row[order - j : -j] for j in range(1, order + 1)], axis=1)
        out[k] = np.linalg.lstsq(lags, row[order:], rcond=None)[0]
    return out


def crosscorr(a: np.ndarray, b: np.ndarray, fs: float = FS, most: int = 25) -> np.ndarray:
    """The strongest correlation within ``most`` lags and its lag in seconds; the first of equals."""
    n = a.shape[1]
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    scale = n * a.std(1) * b.std(1) + EPS
    lags = np.arange(-min(most, n - 1), min(most, n - 1) + 1)
    c = np.stack([(a[:, max(0, k) : n + min(0, k)] * b[:, max(0, -k) : n - max(0, k)]).sum(1) for k in lags], axis=1) / scale[:, None]
    at = np.abs(c).argmax(1)
    return np.stack([c[np.arange(len(c)), at], lags[at] / fs], axis=1)


def stft_power(x: np.ndarray, fs: float = FS, width: int = 32, hop: int = 16, nfft: int = 128) -> tuple[np.ndarray, np.ndarray]:
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    frames = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, ::hop] * window / window.sum()
    return np.fft.rfftfreq(nfft, 1 / fs), np.abs(np.fft.rfft(frames, nfft, axis=2)) ** 2


def moments(x: np.ndarray) -> list[np.ndarray]:
    """mean, std, rms, mean absolute deviation, min, max, skewness, excess kurtosis."""
    mu, sd = x.mean(1), x.std(1)
    c = x - mu[:, None]
    flat = sd < EPS
    safe = np.where(flat, 1, sd)
    return [mu, sd, np.sqrt((x**2).mean(1)), np.abs(c).mean(1), x.min(1), x.max(1), np.where(flat, 0, (c**3).mean(1) / safe**3), np.where(flat, 0, (c**4).mean(1) / safe**4 - 3)]


def zcr(x: np.ndarray) -> np.ndarray:
    s = np.signbit(x)
    return (s[:, 1:] != s[:, :-1]).mean(1) if x.shape[1] > 1 else np.zeros(len(x))


def corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sa, sb = a.std(1), b.std(1)
    live = (sa >= EPS) & (sb >= EPS)
    cov = ((a - a.mean(1, keepdims=True)) * (b - b.mean(1, keepdims=True))).mean(1)
    return np.where(live, cov / np.where(live, sa * sb, 1), 0)
