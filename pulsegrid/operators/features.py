"""The features of a window and of a subject: 18 a channel and one of both, then the vector of 24.

One ``mapInPandas`` stage takes windows (subject_id, win, ir[], red[]) and gives one row a window; everything after it
is plain DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import SQI_LIMITS, Settings
from pulsegrid.functions import kernels, scalars
from pulsegrid.operators import beats

#: Fixed names of a channel's features.
NAMES = (
    "skewness", "kurtosis", "shannon_entropy", "spectral_entropy", "pulse_width", "ppi", "systolic_amplitude", "bpm", "hrv", "teo_mean", "teo_std",
    "derivative1_mean", "derivative2_mean", "derivative2_skewness", "harmonic_ratio", "rise_time", "decay_time", "dicrotic_notch",
)
SQI = tuple(SQI_LIMITS)
COLUMNS = [f"{c}_{n}" for c in ("red", "ir") for n in NAMES] + ["ensemble_ratio"]
SCHEMA = "subject_id long, win long, status string, reason string, beats_ir int, beats_red int, rejections map<string,int>, " + ", ".join(f"{c} double" for c in COLUMNS + [f"{c}_sqi_{n}" for c in ("red", "ir") for n in SQI])


#: The stages that are diagnosed, in order.
STAGES = ("raw", "despiked", "inverted", "low", "smooth", "high")


def filtered(x: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Stages of the filter chain over (windows, samples): ``STAGES``, the normalised signal and the slow part (dc).

    dc is the low-passed signal offline, the low-passed raw signal in inference, and the raw signal in the service.
    """
    f, fs = s.filters, s.sampling.hertz
    despiked = kernels.median_filter(x, f.despike) if f.despike > 1 else x
    turned = -despiked if f.invert else despiked
    lowpass = kernels.butterworth(f.order, f.lowpass_hz, fs)
    low = kernels.zero_phase(lowpass, turned)
    smooth = kernels.savgol(low, *f.smooth) if f.smooth else low
    high = kernels.zero_phase(kernels.butterworth(f.order, f.highpass_hz, fs, True), smooth)
    dc = {"offline": lambda: low, "inference": lambda: kernels.zero_phase(lowpass, x), "service": lambda: x}[s.dialect]()
    return {"raw": x, "despiked": despiked, "inverted": turned, "low": low, "smooth": smooth, "high": high, "norm": kernels.normalise(high, f.normalise), "dc": dc}


def signal_quality(high: np.ndarray, raw: np.ndarray, fs: float) -> dict[str, float | None]:
    """Five measures of a signal without its slow part, and of one with it."""
    g1, g2 = kernels.moments(high, corrected=False)
    dc = float(raw.mean())
    crossings = int((np.diff(np.signbit(high)) != 0).sum())
    return {"skewness": g1, "kurtosis": g2, "perfusion": 100 * float(np.ptp(high)) / abs(dc) if dc else None, "snr_db": kernels.band_snr(*kernels.periodogram(high, fs), 0.5, 5.0, 100.0), "zcr_hz": crossings / 2 / (len(high) / fs)}


def channel(norm: np.ndarray, mean: np.ndarray, rate: float, s: Settings) -> dict[str, float | None]:
    """The 18 features of one channel from its normalised signal and its ensemble beat, as offline and inference have them.

    There is no rise if the beat starts with its peak, and no decay if it ends with it.
    """
    fs = s.sampling.hertz
    v, a = kernels.derivatives(mean, rate)
    if s.dialect == "offline":
        a = beats.fiducials(a, rate)[1]
    dt = (len(mean) / rate) / (len(mean) - 1)
    centred = norm - norm.mean()
    peaks = kernels.find_peaks(centred, 0.33 * fs, max(0.01, 0.1 * centred.std()))
    gaps = np.diff(peaks) / fs
    ppi = float(gaps.mean()) if len(gaps) else None
    hrv = (float(gaps.std(ddof=1) * 1000) if len(gaps) > 1 else 0.0) if len(gaps) else None
    energy = mean[1:-1] ** 2 - mean[:-2] * mean[2:]
    top = int(mean.argmax())
    foot, end = int(mean[: top + 1].argmin()), top + int(mean[top:].argmin())
    after = np.flatnonzero((mean[top + 1 : -1] < mean[top:-2]) & (mean[top + 1 : -1] < mean[top + 2 :]))
    notch = top + 1 + int(after[0]) if len(after) else end
    g1, g2 = kernels.moments(mean)
    return {
        "skewness": g1, "kurtosis": g2, "shannon_entropy": kernels.shannon(norm), "spectral_entropy": kernels.entropy(kernels.welch(norm, fs)[1]),
        "pulse_width": kernels.half_width(mean, top) * dt, "ppi": ppi, "systolic_amplitude": float(np.ptp(mean)), "bpm": 60 / ppi if ppi else None, "hrv": hrv,
        "teo_mean": float(energy.mean()), "teo_std": float(energy.std(ddof=1)), "derivative1_mean": float(v.mean()), "derivative2_mean": float(a.mean()), "derivative2_skewness": kernels.moments(a)[0],
        "harmonic_ratio": kernels.harmonic_ratio(mean), "rise_time": (top - foot) * dt if top > 0 else None, "decay_time": (end - top) * dt if top < len(mean) - 1 else None, "dicrotic_notch": notch * dt,
    }


def service_channel(norm: np.ndarray, mean: np.ndarray, durations: np.ndarray, fs: float) -> dict[str, float | None]:
    """The same names as the service defines them, from the whole normalised signal, its ensemble beat and the accepted beats' seconds.

    Moments are biased; the histogram's entropy is that of its density; energy is taken over the whole signal, its ends repeated;
    rise and decay reach to the nearest valleys, and the width counts samples above half of the rise; intervals are the beats'
    durations; the harmonic ratio is the first peak of the magnitudes to their sum; the notch is the first maximum of the second
    derivative after the peak, as a place in the beat.
    """
    g1, g2 = kernels.moments(norm, False)
    density, edges = np.histogram(norm, 64, density=True)
    inside = density[density > 0]
    energy = np.pad(norm[1:-1] ** 2 - norm[:-2] * norm[2:], 1, mode="edge")
    top = int(mean.argmax())
    valleys = kernels.local_maxima(-mean)
    start = int(valleys[valleys < top][-1]) if (valleys < top).any() else 0
    end = int(valleys[valleys > top][0]) if (valleys > top).any() else len(mean) - 1
    above = int((mean >= mean[start] + 0.5 * (mean[top] - mean[start])).sum())
    ppi = float(durations.mean()) if len(durations) else 0.8
    v = np.gradient(mean)
    a = np.gradient(v)
    waves = np.abs(np.fft.rfft(mean))
    tones = kernels.local_maxima(waves[1:])
    bends = kernels.local_maxima(a[top:])
    notch = len(mean) // 2 if top >= len(mean) - 5 else top + int(bends[0] if len(bends) else a[top:].argmax())
    return {
        "skewness": g1, "kurtosis": g2, "shannon_entropy": float(-(inside * np.log2(inside)).sum()), "spectral_entropy": kernels.entropy(kernels.welch(norm, fs)[1]),
        "pulse_width": above / fs, "ppi": ppi, "systolic_amplitude": float(np.ptp(mean)), "bpm": 60 / ppi, "hrv": float(durations.std() * 1000) if len(durations) > 1 else 30.0,
        "teo_mean": float(energy.mean()), "teo_std": float(energy.std()), "derivative1_mean": float(v.mean()), "derivative2_mean": float(a.mean()), "derivative2_skewness": kernels.moments(a, False)[0],
        "harmonic_ratio": float(waves[1:][tones[0]] / waves.sum()) if len(tones) else 0.0, "rise_time": (top - start) / fs, "decay_time": (end - top) / fs, "dicrotic_notch": float(notch),
    }


def _ratio(a: float, b: float) -> float | None:
    return a / b if b else None


def process(ir: np.ndarray, red: np.ndarray, settings: Settings, stages: dict[str, dict[str, np.ndarray]] | None = None) -> list[dict]:
    """One row a window (same lengths): status, beats, features. Never raises for a window: it is REJECTED or FAILED.

    stages: what ``filtered`` gives for both channels, where it is there already.
    """
    if ir.shape[1] < settings.sampling.least:
        return [{"status": "FAILED", "reason": f"fewer than {settings.sampling.least} samples"} for _ in ir]
    fs, inclusive = settings.sampling.hertz, settings.dialect != "service"
    stages = stages or {"ir": filtered(ir, settings), "red": filtered(red, settings)}
    rows = []
    for k in range(len(ir)):
        row: dict = {"status": "SUCCESS", "reason": None}
        try:
            mean, counts, seconds = {}, {}, {}
            for c in ("ir", "red"):
                norm = stages[c]["norm"][k]
                found = beats.detect(norm, fs, settings.beats) if inclusive else beats.peak_to_peak(norm, fs, settings.beats)
                row[f"beats_{c}"] = len(found.accepted)
                seconds[c] = np.array([p["next_foot"] - p["foot"] for p in found.accepted]) / fs
                for p in [*found.pulses, *found.refused]:
                    if p["reason"]:
                        counts[f"{c}:{p['reason']}"] = counts.get(f"{c}:{p['reason']}", 0) + 1
                mean[c] = beats.ensemble(norm, found, fs, settings.beats, inclusive, inclusive)
                # inference judges the normalised signal against the slow part, the others the filtered against the raw one
                judged = ("norm", "dc") if settings.dialect == "inference" else ("high", "raw")
                row |= {f"{c}_sqi_{n}": x for n, x in signal_quality(*(stages[c][j][k] for j in judged), fs).items()}
            row["rejections"] = counts
            if min(row["beats_ir"], row["beats_red"]) < settings.beats_needed:
                row |= {"status": "REJECTED", "reason": "too_few_beats"}
            elif settings.sqi_gate and not all(lo <= (row[f"{c}_sqi_{n}"] or 0) <= hi for c in ("ir", "red") for n, (lo, hi) in SQI_LIMITS.items()):
                row |= {"status": "REJECTED", "reason": "signal_quality"}
            else:
                part = {}
                for c in ("red", "ir"):
                    norm, beat = stages[c]["norm"][k], mean[c]
                    of_channel = channel(norm, beat[0], beat[2], settings) if inclusive else service_channel(norm, beat[0], seconds[c], fs)
                    row |= {f"{c}_{n}": x for n, x in of_channel.items()}
                    part[c] = _ratio(float(np.ptp(beat[0]) if inclusive else norm.std()), float(stages[c]["dc"][k].mean()))
                # the service has a value where the ratio is not defined
                ratio = _ratio(part["red"] or 0.0, part["ir"] or 0.0) if inclusive or part["red"] is not None else None
                row["ensemble_ratio"] = 0.5 if ratio is None and not inclusive else ratio
        except (ValueError, FloatingPointError, IndexError) as e:
            row |= {"status": "FAILED", "reason": str(e)}
        rows.append(row)
    return rows


#: Windows a worker holds in arrays at once.
BATCH = 256


def stacks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows of windows of one length with their channels as (windows, samples), ``BATCH`` windows at most."""
    for part in (whole.iloc[i : i + BATCH] for whole in parts for i in range(0, len(whole), BATCH)):
        for _, same in part.groupby(part["ir"].map(len)):
            ir, red = (np.stack(same[c].map(lambda v: np.asarray(v, float)).tolist()) for c in ("ir", "red"))
            yield same, ir, red


def window_features(windows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row a window of (subject_id, win, ir[], red[])."""
    s = settings or Settings()
    s = replace(s)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split(" ")[0] for f in SCHEMA.split(", ")]
        for same, ir, red in stacks(parts):
            try:
                rows = process(ir, red, s)
            except ValueError as e:  # too short for the filters
                rows = [{"status": "FAILED", "reason": str(e)}] * len(same)
            out = pd.DataFrame(rows).reindex(columns=names)
            out["subject_id"], out["win"] = same["subject_id"].to_numpy(), same["win"].to_numpy()
            out[["beats_ir", "beats_red"]] = out[["beats_ir", "beats_red"]].astype("Int32")
            out["rejections"] = [x if isinstance(x, dict) else {} for x in out["rejections"]]
            floats = names[7:]
            out[floats] = out[floats].astype(float)
            yield out

    raw = windows.where("ir IS NOT NULL AND red IS NOT NULL").select("subject_id", F.col("win").cast("long").alias("win"), "ir", "red").mapInPandas(run, SCHEMA)
    from pulsegrid.schema import no_nan

    return no_nan(raw)


def subject_average(rows: DataFrame, dialect: str = "offline") -> DataFrame:
    """Means of the accepted windows; inference fills what is missing with 0."""
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if dialect == "inference" else (lambda c: c)
    ok = rows.where("status = 'SUCCESS'")
    return ok.groupBy("subject_id").agg(F.count("*").alias("n_windows"), *[fill(F.avg(c)).alias(c) for c in COLUMNS])


def channel_table(averages: DataFrame) -> DataFrame:
    """A row a subject and feature: the red and the IR value."""
    rows = [F.struct(F.lit(n).alias("feature"), F.col(f"red_{n}").alias("red_value"), F.col(f"ir_{n}").alias("ir_value")) for n in NAMES]
    return averages.select("subject_id", F.explode(F.array(*rows)).alias("r")).select("subject_id", "r.*")


def vector24(averages: DataFrame, dialect: str = "offline") -> DataFrame:
    """The 18 IR features, two ratios, three differences (red, IR) and the ratio of both."""
    empty = {"offline": None, "inference": 0.0, "service": 1.0}[dialect]
    ratio = lambda n: F.coalesce(scalars.safe_ratio(f"red_{n}", f"ir_{n}"), F.lit(empty).cast("double"))
    diff = lambda n: F.col(f"red_{n}") - F.col(f"ir_{n}")
    return averages.select(
        "subject_id", *[F.col(f"ir_{n}") for n in NAMES], ratio("systolic_amplitude").alias("systolic_amplitude_ratio"), ratio("teo_mean").alias("teo_mean_ratio"),
        diff("derivative2_mean").alias("derivative2_mean_difference"), diff("spectral_entropy").alias("spectral_entropy_difference"), diff("dicrotic_notch").alias("dicrotic_notch_difference"), "ensemble_ratio",
    )


#: What the reason keys of a report mean.
REASONS = {
    "edge_candidate_peak_start": "peak too close to the start", "edge_candidate_peak_end": "peak too close to the end", "no_left_valley_found": "no valley before the peak",
    "valley_too_close_to_peak": "valley too close to the peak", "foot_missing": "no foot found", "invalid_ordering": "foot not between valley and peak", "pulse_amplitude_non_positive": "no rise from valley to peak",
    "foot_to_peak_too_short": "rise too fast", "foot_to_peak_too_long": "rise too slow", "foot_too_far_from_valley": "foot too far from the valley", "foot_too_high_on_pulse": "foot too high on the pulse",
    "vpg_not_near_zero_at_foot": "signal not at rest at the foot", "peak_foot_amplitude_too_small": "pulse too small", "no_peak_between_two_feet": "no peak between two feet",
    "no_main_peak_after_foot": "no main peak after the foot", "incomplete_at_signal_start": "pulse cut by the start", "incomplete_at_signal_end": "pulse cut by the end",
    "next_foot_too_close_to_signal_end": "next foot too close to the end", "beat_duration_out_of_range": "beat too short or too long", "foot_to_peak_distance_out_of_range": "rise out of range",
    "upstroke_too_weak": "rise too weak", "beat_too_short_after_segmentation": "too few samples in the beat", "duration_far_from_median": "duration far from the others",
}


def rejection_text(rejections: str = "rejections") -> Column:
    """The reasons of a window as one line: channel, meaning and count of each, in order of the keys; NULL without any."""
    names = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])

    def said(e: Column) -> Column:
        channel, key = F.split_part(e["key"], F.lit(":"), F.lit(1)), F.split_part(e["key"], F.lit(":"), F.lit(2))
        return F.concat(F.upper(channel), F.lit(": "), F.coalesce(F.element_at(names, key), key), F.lit(" ("), e["value"].cast("string"), F.lit(")"))

    lines = F.transform(F.array_sort(F.map_entries(rejections)), said)
    return F.when(F.size(lines) > 0, F.concat_ws("; ", lines))


def rejection_counts(rows: DataFrame) -> DataFrame:
    """Refused candidates and pulses per reason, over all windows."""
    return rows.select(F.explode("rejections").alias("reason_key", "n")).groupBy("reason_key").agg(F.sum("n").alias("n"))


def stage_diagnostics(windows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per window and filter stage: skewness, kurtosis, SNR (Welch, 0.5 to 4 Hz), crossings and perfusion of both channels, and their perfusion ratio."""
    s = settings or Settings()
    fs = s.sampling.hertz

    def measures(x: np.ndarray, dc: float) -> tuple:
        g1, g2 = kernels.moments(x, False)
        c = x - x.mean()
        crossings = int((c[1:] * c[:-1] < 0).sum())
        return g1, g2, kernels.band_snr(*kernels.welch(x, fs, 1024), 0.5, 4.0, 0.0), crossings / 2 / (len(x) / fs), 100 * float(np.ptp(x)) / abs(dc) if dc else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for same, ir, red in stacks(parts):
            keys, rows = list(zip(same["subject_id"], same["win"], strict=True)), []
            try:
                both = filtered(ir, s), filtered(red, s)
            except ValueError:  # too short for the filters: the rows say so by having no measures
                rows = [(*key, stage, *[None] * 11) for key in keys for stage in STAGES]
                both = ()
            for k, key in enumerate(keys if both else ()):
                for stage in STAGES:
                    m = [measures(x[stage][k], float(raw[k].mean())) for x, raw in zip(both, (ir, red), strict=True)]
                    rows.append((*key, stage, *m[0], *m[1], m[1][4] / m[0][4] if m[0][4] else None))
            yield pd.DataFrame(rows, columns=["subject_id", "win", "stage", *[f"{c}_{n}" for c in ("ir", "red") for n in ("skewness", "kurtosis", "snr_db", "zcr_hz", "perfusion")], "r_ratio"])

    numbers = ", ".join(f"{c}_{n} double" for c in ("ir", "red") for n in ("skewness", "kurtosis", "snr_db", "zcr_hz", "perfusion"))
    return windows.select("subject_id", F.col("win").cast("long").alias("win"), "ir", "red").mapInPandas(run, f"subject_id long, win long, stage string, {numbers}, r_ratio double")


def channel_summary(norm: np.ndarray, raw: np.ndarray, fs: float) -> dict[str, float | None]:
    """Nine features of a whole normalised signal: rate, mean width and height of its peaks, area, shape, quality."""
    peaks = kernels.find_peaks(norm, 0.4 * fs, 0.1)
    quality = signal_quality(norm, raw, fs)
    gaps = np.diff(peaks) / fs
    return {
        "hr": float(60 / gaps.mean()) if len(gaps) else None, "width": float(kernels.half_widths(norm, peaks).mean()) / fs if len(peaks) else None,
        "sys_amp": float(norm[peaks].mean()) if len(peaks) else None, "area": float(norm.sum() - (norm[0] + norm[-1]) / 2), "skew": quality["skewness"], "kurt": quality["kurtosis"],
        "pi": 100 * float(np.ptp(raw)) / float(raw.mean()) if raw.mean() else None, "zcr": quality["zcr_hz"], "snr": quality["snr_db"],
    }


def beat_morphology(mean: np.ndarray, rate: float, raw: np.ndarray) -> dict[str, float | None]:
    """Seven features of the ensemble beat."""
    g1, g2 = kernels.moments(mean, False)
    return {
        "hr_global": 60 * rate / len(mean), "width_avg": kernels.half_width(mean, int(mean.argmax())) / rate, "area_avg": float(mean.sum() - (mean[0] + mean[-1]) / 2),
        "amp_avg": float(np.ptp(mean)), "skew_avg": g1, "kurt_avg": g2, "pi_global": 100 * float(np.ptp(raw)) / float(raw.mean()) if raw.mean() else None,
    }


def _beat(norm: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The ensemble beat of a normalised signal, as the dialect has it."""
    fs, inclusive = s.sampling.hertz, s.dialect != "service"
    found = beats.detect(norm, fs, s.beats) if inclusive else beats.peak_to_peak(norm, fs, s.beats)
    return beats.ensemble(norm, found, fs, s.beats, inclusive, inclusive)


def summaries(windows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per window and channel: the nine features of the signal and the seven of its ensemble beat (NULL without one)."""
    s = settings or Settings()
    nine, seven = ("hr", "width", "sys_amp", "area", "skew", "kurt", "pi", "zcr", "snr"), ("hr_global", "width_avg", "area_avg", "amp_avg", "skew_avg", "kurt_avg", "pi_global")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for same, *both in stacks(parts):
            keys, rows = list(zip(same["subject_id"], same["win"], strict=True)), []
            for name, raws in zip(("ir", "red"), both, strict=True):
                try:
                    norms = filtered(raws, s)["norm"]
                except ValueError:  # too short for the filters: the rows have no measures
                    rows += [{"subject_id": sid, "win": win, "channel": name} for sid, win in keys]
                    continue
                for (sid, win), raw, norm in zip(keys, raws, norms, strict=True):
                    beat = _beat(norm, s)
                    rows.append({"subject_id": sid, "win": win, "channel": name, **channel_summary(norm, raw, s.sampling.hertz), **(beat_morphology(beat[0], beat[2], raw) if beat else {})})
            yield pd.DataFrame(rows).reindex(columns=["subject_id", "win", "channel", *nine, *seven]).astype(dict.fromkeys(nine + seven, float))

    schema = "subject_id long, win long, channel string, " + ", ".join(f"{n} double" for n in nine + seven)
    from pulsegrid.schema import no_nan

    return no_nan(windows.select("subject_id", F.col("win").cast("long").alias("win"), "ir", "red").mapInPandas(run, schema))


#: Arrays of a window's artefacts: filtered signals, and the ensemble beat with its derivatives.
SIGNALS = tuple(f"{c}_{n}" for c in ("red", "ir") for n in ("high", "low", "norm"))
BEAT = tuple(f"{c}_{n}" for c in ("red", "ir") for n in ("mean", "velocity", "acceleration"))


def artefacts(windows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per window: its status, the filtered signals of both channels and their ensemble beats, as arrays (NULL where there are none)."""
    s = settings or Settings()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for same, ir, red in stacks(parts):
            rows = [{"subject_id": sid, "win": win, "status": "FAILED"} for sid, win in zip(same["subject_id"], same["win"], strict=True)]
            try:
                stages = {"red": filtered(red, s), "ir": filtered(ir, s)}
                for row, found in zip(rows, process(ir, red, s, stages), strict=True):
                    row["status"] = found["status"]
                for k, row in enumerate(rows):
                    for c, stage in stages.items():
                        row |= {f"{c}_{n}": stage[n][k] for n in ("high", "low", "norm")}
                        if beat := _beat(stage["norm"][k], s):
                            v, a = kernels.derivatives(beat[0], beat[2])
                            row |= {f"{c}_mean": beat[0], f"{c}_velocity": v, f"{c}_acceleration": a}
            except ValueError:  # too short for the filters
                pass
            out = pd.DataFrame(rows).reindex(columns=["subject_id", "win", "status", *SIGNALS, *BEAT]).astype(object)
            yield out.where(out.notna(), None)

    schema = "subject_id long, win long, status string, " + ", ".join(f"{n} array<double>" for n in SIGNALS + BEAT)
    return windows.select("subject_id", F.col("win").cast("long").alias("win"), "ir", "red").mapInPandas(run, schema)
