"""Beats of one normalised window: feet and pulses, with a reason for each that is refused, and the ensemble beat.

Rules are columns of one boolean table, evaluated for all candidates at once; the first rule a candidate breaks is its
reason. Reason keys are fixed values of the rejection report.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from pulsegrid.config import Beats
from pulsegrid.functions import kernels


@dataclass
class Found:
    pulses: list[dict] = field(default_factory=list)  # every pulse: foot, peak, next_foot, reason ("" if accepted)
    refused: list[dict] = field(default_factory=list)  # candidates: peak, foot, valley, reason

    @property
    def accepted(self) -> list[dict]:
        return [p for p in self.pulses if not p["reason"]]


def first_broken(rules: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Per column the name of the first rule that is true, else an empty string."""
    broken = np.stack([b for _, b in rules])
    names = np.array([n for n, _ in rules] + [""], dtype=object)
    return names[np.where(broken.any(0), broken.argmax(0), len(rules))]


def refine_foot(valley: int, peak: int, v: np.ndarray, a: np.ndarray) -> int:
    """The foot between a valley and its peak: where the velocity last turns positive before its maximum.

    Without a turn: where it is closest to zero in the first 60 % of the way. A foot after the largest acceleration
    moves back to the slowest sample up to there.
    """
    if peak <= valley + 4:
        return valley
    top = valley + int(v[valley : peak + 1].argmax())
    if top <= valley + 1:
        return valley
    way = v[valley : top + 1]
    turns = np.flatnonzero((way[:-1] < 0) & (way[1:] >= 0))
    if len(turns):
        k = turns[-1]
        foot = int(k + (abs(way[k]) > abs(way[k + 1])))
    else:
        foot = int(np.abs(way[: max(3, int(0.6 * len(way)))]).argmin())
    bend = int(a[valley : top + 1].argmax())
    if foot > bend:
        foot = int(np.abs(way[: bend + 1]).argmin())
    return valley + min(foot, top - valley - 1)


def main_peaks(peaks: np.ndarray, f1: np.ndarray, f2: np.ndarray, fs: float, s: Beats) -> tuple[np.ndarray, np.ndarray]:
    """Per beat (foot f1, next foot f2) the first peak that comes soon enough after the foot, and whether there is one."""
    first = np.searchsorted(peaks, f1 + int(s.main_peak[0] * fs))
    main = peaks[np.minimum(first, len(peaks) - 1)]
    return main, (first < len(peaks)) & (main <= f1 + int(s.main_peak[1] * fs)) & (main < f2) & (main > f1)


def far_from_median(length: np.ndarray, ok: np.ndarray, tolerance: float) -> np.ndarray:
    """Of the beats that are ok, those whose duration is more than ``tolerance`` times off their median; none below three."""
    if ok.sum() < 3:
        return np.zeros(len(length), bool)
    mid = np.median(length[ok])
    return ok & ((length < mid / tolerance) | (length > mid * tolerance))


def detect(x: np.ndarray, fs: float, s: Beats | None = None) -> Found:
    s, out = s or Beats(), Found()
    smooth = kernels.savgol(x, max(7, int(0.05 * fs)), 3)
    v, a = kernels.derivatives(x, fs)
    n, reach, sd, sd_v = len(x), float(np.ptp(smooth)), float(smooth.std()), float(v.std())
    peaks = kernels.find_peaks(smooth, s.peak_distance * fs, max(s.peak_prominence_floor, s.peak_prominence * reach))
    valleys = kernels.find_peaks(-smooth, s.valley_distance * fs, max(s.valley_prominence_floor, s.valley_prominence * reach))
    if not len(peaks):
        return out
    # as-of: the last valley before each peak
    k = np.searchsorted(valleys, peaks) - 1
    valley = np.where(k >= 0, valleys[np.maximum(k, 0)] if len(valleys) else 0, -1)
    foot = np.array([refine_foot(int(b), int(p), v, a) if b >= 0 else 0 for b, p in zip(valley, peaks, strict=True)])
    at = np.maximum(valley, 0)
    rise, to_peak = smooth[peaks] - smooth[at], (peaks - foot) / fs
    low, high = s.foot_to_peak
    floor = max(0.01, 0.02 * sd)
    reason = first_broken(
        [
            ("edge_candidate_peak_start", peaks < int(s.edge * fs)),
            ("edge_candidate_peak_end", peaks > n - int(s.edge * fs)),
            ("no_left_valley_found", valley < 0),
            ("valley_too_close_to_peak", peaks - valley < int(low * fs)),
            ("invalid_ordering", ~((at <= foot) & (foot < peaks))),
            ("pulse_amplitude_non_positive", rise <= 0),
            ("foot_to_peak_too_short", to_peak < low),
            ("foot_to_peak_too_long", to_peak > high),
            ("foot_too_far_from_valley", (foot - at) / fs > s.valley_to_foot),
            ("foot_too_high_on_pulse", smooth[foot] - smooth[at] > s.foot_height * rise),
            ("vpg_not_near_zero_at_foot", np.abs(v[foot]) > s.foot_velocity),
            ("peak_foot_amplitude_too_small", smooth[peaks] - smooth[foot] <= floor),
        ]
    )
    out.refused = [{"peak": int(p), "foot": int(f), "valley": int(b), "reason": r} for p, f, b, r in zip(peaks, foot, valley, reason, strict=True) if r]
    feet = np.unique(foot[reason == ""])
    if len(feet) < 2:
        return out
    f1, f2 = feet[:-1], feet[1:]
    between = np.searchsorted(peaks, f2) > np.searchsorted(peaks, f1, "right")
    main, has = main_peaks(peaks, f1, f2, fs, s)
    p = np.where(has, main, f1 + 1)
    length, up = (f2 - f1) / fs, np.array([v[i : j + 1].max() for i, j in zip(f1, p, strict=True)])
    ahead, behind = int(s.start_margin * fs), n - int(s.end_margin * fs)
    reason = first_broken(
        [
            ("no_peak_between_two_feet", ~between),
            ("no_main_peak_after_foot", ~has),
            ("incomplete_at_signal_start", f1 < ahead),
            ("incomplete_at_signal_end", p > behind),
            ("next_foot_too_close_to_signal_end", f2 > behind),
            ("beat_duration_out_of_range", (length < s.duration[0]) | (length > s.duration[1])),
            ("foot_to_peak_distance_out_of_range", ((p - f1) / fs < low) | ((p - f1) / fs > high)),
            ("peak_foot_amplitude_too_small", smooth[p] - smooth[f1] <= floor),
            ("upstroke_too_weak", up <= max(0.05, 0.05 * sd_v)),
            ("beat_too_short_after_segmentation", f2 - f1 + 1 <= 10),
        ]
    )
    reason[far_from_median(length, reason == "", s.median_tolerance)] = "duration_far_from_median"
    out.pulses = [{"foot": int(i), "peak": int(j), "next_foot": int(k), "reason": r} for i, j, k, r in zip(f1, p, f2, reason, strict=True)]
    return out


def peak_to_peak(x: np.ndarray, fs: float, s: Beats | None = None) -> Found:
    """The service's plainer segmentation: from peak to peak, at least three of them."""
    s, out = s or Beats(), Found()
    peaks = kernels.find_peaks(x, s.peak_distance * fs, max(s.peak_prominence_floor, s.peak_prominence * float(np.ptp(x))))
    if len(peaks) >= 3:
        length = np.diff(peaks) / fs
        for i, j, d in zip(peaks, peaks[1:], length, strict=False):
            fine = s.duration[0] <= d <= s.duration[1]
            out.pulses.append({"foot": int(i), "peak": int(i), "next_foot": int(j), "reason": "" if fine else "beat_duration_out_of_range"})
    return out


def resample(x: np.ndarray, n: int) -> np.ndarray:
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(x)), x)


def ensemble(x: np.ndarray, found: Found, fs: float, s: Beats | None = None, inclusive: bool = True, align: bool = True) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Mean and standard deviation of the resampled beats, aligned by their fastest rise; and the beat's sampling rate."""
    s = s or Beats()
    beats = [x[p["foot"] : p["next_foot"] + inclusive] for p in found.accepted]
    if not beats:
        return None
    rate = s.target_length / float(np.median([len(b) / fs for b in beats]))
    m = np.stack([resample(b, s.target_length) for b in beats])
    if align:
        v = kernels.savgol(np.gradient(m, axis=1) * rate, max(5, int(0.03 * rate)), 2)
        shift = int(v.mean(0).argmax()) - v.argmax(1)
        at = np.clip(np.arange(s.target_length) - shift[:, None], 0, s.target_length - 1)
        m = np.take_along_axis(m, at, 1)
    return m.mean(0), m.std(0), rate


def fiducials(acceleration: np.ndarray, rate: float) -> tuple[dict[str, int | None], np.ndarray]:
    """Waves a to e of the smoothed second derivative, which is returned too."""
    y = kernels.savgol(acceleration, max(7, int(0.05 * rate)), 3)
    apart = max(3, int(0.05 * rate))
    tops, dips = kernels.find_peaks(y, apart), kernels.find_peaks(-y, apart)
    out: dict[str, int | None] = dict.fromkeys("abcde")
    early = tops[tops < int(0.35 * len(y))]
    if len(early):
        out["a"] = at = int(early[y[early].argmax()])
        for name, where in zip("bcde", (dips, tops, dips, tops), strict=True):
            later = where[where > at]
            if not len(later):
                break
            out[name] = at = int(later[0])
    return out, y
