"""Numeric kernels in numpy, from public definitions. The filters run over a batch of signals, (signals, samples), at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=32)
def _butterworth(order: int, hertz: float, fs: float, high: bool) -> tuple[tuple[float, ...], ...]:
    """Second-order sections (b0 b1 b2 a1 a2) by the bilinear transform of the analog prototype; even orders."""
    if order % 2:
        raise ValueError("even orders only")
    warped = 2 * fs * np.tan(np.pi * hertz / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(order // 2) + order + 1) / (2 * order))
    out = []
    for p in poles:
        s = warped / p if high else warped * p
        z = (2 * fs + s) / (2 * fs - s)
        a1, a2 = -2 * z.real, abs(z) ** 2
        # unit gain at zero frequency (low-pass) or at half the sampling rate (high-pass)
        b = (1 - a1 + a2) / 4 if high else (1 + a1 + a2) / 4
        out.append((b, (-2 if high else 2) * b, b, a1, a2))
    return tuple(out)


def butterworth(order: int, hertz: float, fs: float, high: bool = False) -> np.ndarray:
    return np.array(_butterworth(order, hertz, fs, high))


def _run(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One pass over (samples, signals), from the steady state of the first sample."""
    y, gain = x, 1.0
    for b0, b1, b2, a1, a2 in sections:
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        first = x[0] * gain
        s1, s2 = (dc - b0) * first, (b2 - a2 * dc) * first
        out = np.empty_like(y)
        for i, v in enumerate(y):
            w = b0 * v + s1
            s1 = b1 * v - a1 * w + s2
            s2 = b2 * v - a2 * w
            out[i] = w
        y, gain = out, gain * dc
    return y


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, over an odd extension at both ends; signals must be longer than the extension."""
    pad = 3 * (2 * len(sections) + 1)
    if x.shape[-1] <= pad:
        raise ValueError(f"signals need more than {pad} samples")
    t = np.moveaxis(np.asarray(x, float), -1, 0)
    ext = np.concatenate([2 * t[0] - t[pad:0:-1], t, 2 * t[-1] - t[-2 : -pad - 2 : -1]])
    y = _run(sections, _run(sections, ext)[::-1])[::-1]
    return np.moveaxis(y[pad:-pad], 0, -1)


def median_filter(x: np.ndarray, k: int = 3) -> np.ndarray:
    """Running median over the last axis; zeros lie outside."""
    h = k // 2
    ext = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(h, h)])
    return np.median(np.lib.stride_tricks.sliding_window_view(ext, k, axis=-1), axis=-1)


@lru_cache(maxsize=64)
def _projection(window: int, degree: int) -> np.ndarray:
    """(window, window): values of the fitted polynomial from samples."""
    basis = np.vander(np.arange(-(window // 2), window // 2 + 1), degree + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def savgol(x: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Least-squares smoothing over the last axis; ends from the polynomial of the first and last whole window.

    Even windows grow by one, too long ones shrink to the largest odd number below the length, 5 at least.
    """
    n = x.shape[-1]
    window += 1 - window % 2
    if window >= n:
        window = n - 1 if n % 2 == 0 else n - 2
    window = max(window, 5)
    if window > n or degree >= window:
        return x
    h = window // 2
    project = _projection(window, degree)
    view = np.lib.stride_tricks.sliding_window_view(x, window, axis=-1)
    out = np.empty(x.shape, float)
    out[..., h : n - h] = view @ project[h]
    out[..., :h] = x[..., :window] @ project[:h].T
    out[..., n - h :] = x[..., -window:] @ project[h + 1 :].T
    return out


def derivatives(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed velocity and acceleration."""
    long, short = max(7, int(0.05 * fs)), max(5, int(0.03 * fs))
    v = savgol(np.gradient(savgol(x, long, 3), axis=-1) * fs, short, 2)
    return v, savgol(np.gradient(v, axis=-1) * fs, short, 2)


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict maxima; of a plateau the middle sample."""
    if len(x) < 3:
        return np.zeros(0, int)
    edge = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.append(0, edge + 1), np.append(edge, len(x) - 1)
    level = x[starts]
    top = np.zeros(len(level), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[top] + ends[top]) // 2


def _bases(heights: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For each of some tops in order: the lowest sample since the last higher top, by a stack of falling heights.

    lows: the lowest sample from the top before (exclusive) to each top. Every top is put on the stack and taken off once.
    """
    out, stack = np.empty(len(heights)), []
    for i, (h, low) in enumerate(zip(heights.tolist(), lows.tolist(), strict=True)):
        while stack and stack[-1][0] <= h:
            low = min(low, stack.pop()[1])
        out[i] = low
        stack.append((h, low))
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Heights of peaks over the higher of their two bases: the lowest samples on the way to higher ground or to an end.

    Higher ground is reached at a maximum or an end of the signal, so only these are looked at, in one pass a side.
    """
    if not len(peaks):
        return np.empty(0)
    tops = np.unique(np.concatenate([local_maxima(x), peaks, [0, len(x) - 1]]))
    left = _bases(x[tops], np.minimum.reduceat(x, np.append(0, tops[:-1] + 1)) if len(tops) > 1 else x[tops])
    turned = (len(x) - 1 - tops)[::-1]
    back = x[::-1]
    right = _bases(back[turned], np.minimum.reduceat(back, np.append(0, turned[:-1] + 1)) if len(tops) > 1 else back[turned])[::-1]
    at = np.searchsorted(tops, peaks)
    return x[peaks] - np.maximum(left[at], right[at])


def find_peaks(x: np.ndarray, distance: float = 1, prominence: float | None = None) -> np.ndarray:
    """Maxima, thinned to the distance (higher ones first), then by prominence."""
    peaks = local_maxima(x)
    if distance > 1 and len(peaks):
        reach = int(np.ceil(distance))
        first, last = np.searchsorted(peaks, peaks - reach, "right").tolist(), np.searchsorted(peaks, peaks + reach).tolist()
        keep = bytearray(b"\1" * len(peaks))
        for k in np.argsort(x[peaks], kind="stable")[::-1].tolist():
            if keep[k]:
                keep[first[k] : last[k]] = bytes(last[k] - first[k])
                keep[k] = 1
        peaks = peaks[np.frombuffer(keep, bool)]
    if prominence is not None:
        peaks = peaks[prominences(x, peaks) >= prominence]
    return peaks


def half_widths(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Widths in samples of peaks at half their prominence, by linear interpolation; prominences are measured once for all."""
    out = np.empty(len(peaks))
    for k, (peak, high) in enumerate(zip(peaks.tolist(), prominences(x, peaks).tolist(), strict=True)):
        level = x[peak] - high / 2
        low = x <= level
        before, after = low[peak::-1].argmax(), low[peak:].argmax()
        i = peak - int(before) if low[peak - before] else 0
        j = peak + int(after) if low[peak + after] else len(x) - 1
        left = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
        right = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else float(j)
        out[k] = right - left
    return out


def half_width(x: np.ndarray, peak: int) -> float:
    return float(half_widths(x, np.array([peak]))[0])


def periodogram(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density of the mean-free signal."""
    n = len(x)
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2 / (fs * n)
    power[1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def fft_magnitude(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Amplitudes of the mean-free signal at the frequencies below half the sampling rate."""
    n = len(x)
    return np.arange(n // 2) * fs / n, 2 / n * np.abs(np.fft.fft(x - x.mean()))[: n // 2]


def decimate(x: np.ndarray, by: int, taps: int = 101) -> np.ndarray:
    """Every ``by``-th sample of the last axis after a windowed-sinc low-pass (Hamming) at the new half rate, without delay."""
    h = taps // 2
    i = np.arange(-h, h + 1)
    kernel = np.sinc(i / by) / by * (0.54 + 0.46 * np.cos(np.pi * i / h))
    kernel /= kernel.sum()
    ext = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(h, h)], mode="edge")
    return (np.lib.stride_tricks.sliding_window_view(ext, taps, axis=-1) @ kernel)[..., ::by]


def welch(x: np.ndarray, fs: float, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Mean one-sided density of half-overlapping mean-free segments under a periodic Hann window."""
    n = min(segment, len(x))
    step = n - n // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    power = (np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window)) ** 2).mean(0) / (fs * (window**2).sum())
    power[1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def band_snr(f: np.ndarray, p: np.ndarray, low: float, high: float, fallback: float) -> float:
    """Decibels of the power inside the band to the power outside."""
    inside = (f >= low) & (f <= high)
    noise = p[~inside].sum()
    return float(10 * np.log10(p[inside].sum() / noise)) if noise > 0 and p[inside].sum() > 0 else fallback


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    p = p / p.sum() if len(p) else p
    return float(-(p * np.log2(p)).sum()) + 0.0


def shannon(x: np.ndarray, bins: int = 64) -> float:
    return entropy(np.histogram(x, bins)[0].astype(float))


def moments(x: np.ndarray, corrected: bool = True) -> tuple[float | None, float | None]:
    """Skewness and excess kurtosis, bias-corrected or not; None where they are not defined."""
    n, d = len(x), x - x.mean() if len(x) else x
    m2 = (d**2).mean() if n else 0.0
    if n < 4 or m2 <= 0:
        return None, None
    g1, g2 = (d**3).mean() / m2**1.5, (d**4).mean() / m2**2 - 3
    if not corrected:
        return float(g1), float(g2)
    return float(g1 * np.sqrt(n * (n - 1)) / (n - 2)), float((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def harmonic_ratio(x: np.ndarray) -> float | None:
    """Power of the strongest frequency to that of all others."""
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2 if len(x) >= 8 else np.zeros(0)
    p[:1] = 0
    rest = p.sum() - p.max(initial=0)
    return float(p.max() / rest) if len(p) >= 3 and rest > 0 else None


def normalise(x: np.ndarray, how: str = "minmax") -> np.ndarray:
    """Over the last axis; a constant signal becomes zeros."""
    if how == "minmax":
        base, spread = x.min(-1, keepdims=True), np.ptp(x, axis=-1, keepdims=True)
    else:
        base, spread = x.mean(-1, keepdims=True), x.std(-1, keepdims=True)
    return np.where(spread > 0, (x - base) / np.where(spread > 0, spread, 1), 0.0)
