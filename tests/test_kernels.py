import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.config import Settings
from pulsegrid.functions import kernels as k
from pulsegrid.operators import beats, features

FS = 400.0
T = np.arange(6000) / FS


def pulse_wave(seconds=15.0, rate=1.2, fs=FS):
    """Fast rise, slow fall, a second small wave; turned over like the light that reaches the sensor."""
    t = np.arange(int(seconds * fs)) / fs
    phase = (t * rate) % 1.0
    wave = np.exp(-((phase - 0.22) ** 2) / 0.006) + 0.35 * np.exp(-((phase - 0.50) ** 2) / 0.012)
    return 80_000 - 2_000 * wave + 50 * np.sin(0.1 * t)


def direct(sections, x):
    """The difference equation, sample by sample, from rest."""
    for b0, b1, b2, a1, a2 in sections:
        y = np.zeros(len(x))
        for n in range(len(x)):
            y[n] = b0 * x[n] + (b1 * x[n - 1] - a1 * y[n - 1] if n else 0) + (b2 * x[n - 2] - a2 * y[n - 2] if n > 1 else 0)
        x = y
    return x


def test_butterworth_response():
    for high in (False, True):
        s = k.butterworth(4, 16.0, FS, high)
        h = np.abs(np.fft.rfft(direct(s, (np.arange(8192) == 0).astype(float))))
        f = np.fft.rfftfreq(8192, 1 / FS)
        at = h[np.abs(f - 16.0).argmin()]
        assert abs(at - np.sqrt(0.5)) < 2e-3
        assert abs(h[-1 if high else 0] - 1) < 1e-6 and h[0 if high else -1] < 1e-6


def test_zero_phase():
    low = k.butterworth(4, 16.0, FS)
    x = np.sin(2 * np.pi * 2 * T)
    assert np.abs(k.zero_phase(low, x[None])[0] - x)[100:-100].max() < 1e-5
    impulse = (np.arange(2001) == 1000).astype(float)
    y = k.zero_phase(low, impulse[None])[0]
    assert np.abs(y - y[::-1]).max() < 1e-12
    assert np.abs(k.zero_phase(k.butterworth(4, 0.5, FS, True), np.ones((1, 500)))).max() < 1e-9
    both = k.zero_phase(low, np.stack([x, 2 * x]))
    assert np.allclose(both[1], 2 * both[0])


def test_median_and_savgol():
    assert k.median_filter(np.array([5.0, 1, 9, 2, 7])).tolist() == [1, 5, 2, 7, 2]
    cubic = np.polyval([0.2, -1, 3, 2], np.linspace(-3, 3, 41))
    assert np.allclose(k.savgol(cubic, 21, 3), cubic)
    x = np.random.default_rng(0).standard_normal(50)
    mid = np.array([-3, 12, 17, 12, -3]) / 35
    assert np.allclose(k.savgol(x, 5, 2)[2:-2], np.convolve(x, mid, "valid"))


def brute_peaks(x, distance, prominence):
    """By the definition, pair by pair."""
    n, out, i = len(x), [], 1
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    keep = set(out)
    for p in sorted(out, key=lambda p: (x[p], p), reverse=True):
        if p in keep:
            keep -= {q for q in keep if q != p and abs(q - p) < np.ceil(distance)}
    final = []
    for p in sorted(keep):
        left = right = x[p]
        a = p
        while a >= 0 and x[a] <= x[p]:
            left = min(left, x[a])
            a -= 1
        b = p
        while b < n and x[b] <= x[p]:
            right = min(right, x[b])
            b += 1
        if x[p] - max(left, right) >= prominence:
            final.append(p)
    return final


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=3, max_size=40), st.integers(1, 8), st.integers(0, 3))
def test_peaks_by_definition(values, distance, prominence):
    x = np.array(values, float)
    assert k.find_peaks(x, distance, prominence).tolist() == brute_peaks(x, distance, prominence)


def test_spectra():
    x = np.sin(2 * np.pi * 5 * T) + 0.5
    f, p = k.periodogram(x, FS)
    assert abs(f[p.argmax()] - 5) < 0.1 and abs(p.sum() * (f[1] - f[0]) - x.var()) < 1e-6
    n = 64
    seg = np.random.default_rng(1).standard_normal(n)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    d = np.array([(w * (seg - seg.mean()) * np.exp(-2j * np.pi * q * np.arange(n) / n)).sum() for q in range(n // 2 + 1)])
    want = np.abs(d) ** 2 / (FS * (w**2).sum())
    want[1:-1] *= 2
    assert np.allclose(k.welch(seg, FS, n)[1], want)
    assert k.shannon(np.ones(10)) == 0 and k.harmonic_ratio(np.ones(20)) is None


def test_moments_and_width():
    x = np.array([1.0, 2, 3, 10])
    d = x - x.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    assert np.isclose(k.moments(x)[0], g1 * np.sqrt(12) / 2) and np.isclose(k.moments(x, False)[0], g1)
    assert k.moments(np.ones(9)) == (None, None)
    assert np.isclose(k.half_width(np.array([0.0, 1, 2, 1, 0]), 2), 2.0)


def test_beats_of_a_clean_pulse():
    rows = features.process(pulse_wave()[None], (0.9 * pulse_wave())[None], Settings())
    r = rows[0]
    assert r["status"] == "SUCCESS", r
    assert r["beats_ir"] >= 12 and abs(r["ir_bpm"] - 72) < 0.5 and abs(r["ir_ppi"] - 1 / 1.2) < 0.01
    # beats are cut from min-max normalised signals, so both have the same range: what is left is the ratio of the DC levels
    assert abs(r["ensemble_ratio"] - 1 / 0.9) < 1e-6
    for d in ("inference", "service"):
        assert features.process(pulse_wave()[None], pulse_wave()[None], Settings(dialect=d))[0]["status"] == "SUCCESS"


def test_inference_judges_the_normalised_signal():
    s = Settings(dialect="inference")
    wave = pulse_wave()
    stages = features.filtered(wave[None], s)
    want = features.signal_quality(stages["norm"][0], k.zero_phase(k.butterworth(4, 16.0, FS), wave[None])[0], FS)
    row = features.process(wave[None], wave[None], s)[0]
    assert all(np.isclose(row[f"ir_sqi_{n}"], v) for n, v in want.items())
    assert features.STAGES == ("raw", "despiked", "inverted", "low", "smooth", "high") and all(n in stages for n in features.STAGES)


def test_decimation_and_spectrum():
    slow, fast = np.sin(2 * np.pi * 2 * T), np.sin(2 * np.pi * 90 * T)
    y = k.decimate(np.stack([slow, fast]), 8)
    assert y.shape == (2, 750) and np.abs(y[0] - slow[::8])[20:-20].max() < 0.01 and np.abs(y[1])[20:-20].max() < 0.01
    f, a = k.fft_magnitude(3 * slow + 5, FS)
    assert abs(f[a.argmax()] - 2) < 1e-9 and abs(a.max() - 3) < 1e-9 and len(f) == 3000


def test_scale_invariance_and_rejection():
    a = features.process(pulse_wave()[None], pulse_wave()[None], Settings())[0]
    b = features.process(3 * pulse_wave()[None], 3 * pulse_wave()[None], Settings())[0]
    assert np.isclose(a["ir_shannon_entropy"], b["ir_shannon_entropy"]) and np.isclose(a["ir_ppi"], b["ir_ppi"])
    flat = np.full((1, 6000), 7.0)
    assert features.process(flat, flat, Settings())[0]["status"] in ("REJECTED", "FAILED")


def test_rules_name_the_first_broken():
    got = beats.first_broken([("a", np.array([False, True, False])), ("b", np.array([True, True, False]))])
    assert got.tolist() == ["b", "a", ""]


def test_fiducials_in_order():
    x = pulse_wave(1 / 1.2)[::-1].copy()
    f, _ = beats.fiducials(np.gradient(np.gradient(x)), 220.0)
    found = [v for v in f.values() if v is not None]
    assert found == sorted(found)


def test_service_features_where_they_are_not_defined():
    """Fallbacks of the service: no beats, one beat, a peak at the end, no tone, no notch."""
    norm = np.linspace(0, 1, 400) ** 2
    up = np.linspace(0, 1, 220)
    none = features.service_channel(norm, up, np.zeros(0), 400.0)
    assert (none["ppi"], none["bpm"], none["hrv"], none["decay_time"], none["dicrotic_notch"]) == (0.8, 75.0, 30.0, 0.0, 110.0)
    assert features.service_channel(norm, up, np.array([0.9]), 400.0)["hrv"] == 30.0
    assert features.service_channel(norm, up, np.array([0.8, 1.0]), 400.0)["hrv"] == pytest.approx(100.0)
    beat = np.r_[0.2, 0.0, 0.5, 1.0, 0.6, 0.3, 0.4, 0.2, 0.1, 0.1, 0.1, 0.1]
    got = features.service_channel(norm, beat, np.array([1.0]), 10.0)
    assert (got["rise_time"], got["decay_time"], got["pulse_width"]) == (0.2, 0.2, 0.3)
    waves = np.abs(np.fft.rfft(beat))
    first = next(k for k in range(2, len(waves) - 1) if waves[k - 1] < waves[k] > waves[k + 1])
    assert got["harmonic_ratio"] == pytest.approx(waves[first] / waves.sum())


def test_no_rise_or_decay_at_the_ends():
    s, norm = Settings(), np.sin(np.arange(6000) / 40)
    falling, rising = np.linspace(1, 0, 220), np.linspace(0, 1, 220)
    assert features.channel(norm, falling, 220.0, s)["rise_time"] is None and features.channel(norm, falling, 220.0, s)["decay_time"] > 0
    assert features.channel(norm, rising, 220.0, s)["decay_time"] is None and features.channel(norm, rising, 220.0, s)["rise_time"] > 0


def plain_prominences(x, peaks):
    out = []
    for p in peaks:
        above = np.flatnonzero(x[:p] > x[p])
        left = x[above[-1] + 1 if len(above) else 0 : p + 1].min()
        above = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : p + 1 + above[0] if len(above) else len(x)].min()
        out.append(x[p] - max(left, right))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.data())
def test_prominences_of_plateaus_and_ends(values, data):
    x = np.array(values, float)
    some = np.array(sorted(data.draw(st.sets(st.integers(0, len(x) - 1)))), int)
    for peaks in (k.local_maxima(x), some):
        assert k.prominences(x, peaks).tolist() == plain_prominences(x, peaks)


def test_windows_are_filtered_at_once_and_widths_measured_at_once(monkeypatch):
    from pulsegrid.plans import kernel_queries

    x, calls = np.random.default_rng(3).normal(size=(5, 200)), []
    zero_phase, prominences = k.zero_phase, k.prominences
    monkeypatch.setattr(k, "zero_phase", lambda s, v: calls.append("filter") or zero_phase(s, v))
    rows = kernel_queries.low_high(x)
    assert calls == ["filter"] * 2 and rows == [r for one in x for r in kernel_queries.low_high(one[None])]
    monkeypatch.setattr(k, "prominences", lambda v, p: calls.append("prominences") or prominences(v, p))
    peaks, before = k.local_maxima(x[0]), len(calls)
    widths = k.half_widths(x[0], peaks)
    assert calls[before:] == ["prominences"] and [k.half_width(x[0], int(p)) for p in peaks] == widths.tolist()
