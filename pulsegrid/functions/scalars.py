"""Scalar expressions: all built-in functions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.config import BIN_EDGES, BIN_NAMES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def safe_ratio(a, b) -> Column:
    """NULL where the denominator is zero or either side is missing."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def clip(x, low, high) -> Column:
    """x within [low, high]; NULL stays NULL."""
    return F.when(_c(x).isNotNull(), F.greatest(_c(low), F.least(_c(high), _c(x))))


def decibel(a, b, fallback: float = 100.0) -> Column:
    """10 log10(a / b); the fallback where b is not positive."""
    return F.when(_c(b) > 0, 10 * F.log10(_c(a) / _c(b))).otherwise(F.lit(fallback))


def range_left(x, edges: Sequence[float] = BIN_EDGES) -> Column:
    """Index of the left-closed range [edge, next edge); NULL outside."""
    c = _c(x)
    return reduce(lambda w, i: w.when((c >= edges[i]) & (c < edges[i + 1]), i), range(1, len(edges) - 1), F.when((c >= edges[0]) & (c < edges[1]), 0))


def class_right(x, edges: Sequence[float] = BIN_EDGES, names: Sequence[str] = BIN_NAMES) -> Column:
    """Name of the right-closed class: below the first edge, then up to and with each upper edge."""
    c = _c(x)
    w = F.when(c < edges[1], names[0])
    for edge, name in zip(edges[2:-1], names[1:-1], strict=True):
        w = w.when(c <= edge, name)
    return w.when(c.isNotNull(), names[-1])


def clarke_zone(actual, predicted) -> Column:
    """Zone A to E of the error grid, tested in this order.

    Low is below 70, high above 180. A: within a fifth of the reference, or both low. E: one low, the other high. D: a
    reference that is low or above 240, predicted in between. C: a reference in between, predicted low or high and more than a
    fifth off by its product with 0.8 or 1.2, which rounding can tell from the difference of zone A. B: the rest.
    """
    r, p = _c(actual), _c(predicted)
    low, high, between = (lambda x: x < 70), (lambda x: x > 180), (lambda x: x.between(70, 180))
    a = (F.abs(p - r) <= 0.20 * r) | (low(r) & low(p))
    e = (low(r) & high(p)) | (high(r) & low(p))
    d = (low(r) | (r > 240)) & between(p)
    c = between(r) & ((high(p) & (p > 1.20 * r)) | (low(p) & (p < 0.80 * r)))
    return F.when(r.isNull() | p.isNull(), F.lit(None)).when(a, "A").when(e, "E").when(d, "D").when(c, "C").otherwise("B")


def error_ratio(test, train) -> Column:
    """Test to training error; infinite where training left no error, NULL where either is missing."""
    return F.when(_c(test).isNotNull() & (_c(train) == 0), F.lit(float("inf"))).otherwise(safe_ratio(test, train))


def overfit_verdict(ratio) -> Column:
    """By the ratio of test to training error, severe first; a test error well below the training error is unusual."""
    r = _c(ratio)
    return F.when(r > 3.0, "severe").when(r > 2.0, "moderate").when(r > 1.5, "mild").when(r >= 0.8, "good").when(r.isNotNull(), "test_better")


def fit_verdict(r2_train, r2_test, mae_ratio, rmse_ratio) -> Column:
    """Gaps and ratios of the two splits as one word: overfitting wins, underfitting needs both splits below 0.70."""
    over = (_c(r2_train) - _c(r2_test) > 0.05) | (_c(mae_ratio) > 1.15) | (_c(rmse_ratio) > 1.15)
    under = (_c(r2_train) < 0.70) & (_c(r2_test) < 0.70)
    return F.when(over, "overfitting").when(under, "underfitting").otherwise("well_generalised")


def fit_scores(r2_train, r2_test, mae_ratio, rmse_ratio) -> tuple[Column, Column]:
    """How far a fit is from generalising (gap and ratios above 1) and from fitting at all (R2 below 0.7)."""
    over = lambda x: F.greatest(F.lit(0.0), x)
    worse = 0.4 * over(_c(r2_train) - _c(r2_test)) + 0.3 * over(_c(rmse_ratio) - 1.0) + 0.3 * over(_c(mae_ratio) - 1.0)
    return worse, 0.5 * over(0.70 - _c(r2_train)) + 0.5 * over(0.70 - _c(r2_test))


def status(x, low, high) -> Column:
    """PASS within the inclusive limits, else FAIL."""
    return F.when(_c(x).between(low, high), "PASS").otherwise("FAIL")


def gauge(x, low: float = 40.0, high: float = 240.0) -> Column:
    """Position on a dial from 0 to 1."""
    return (clip(x, F.lit(low), F.lit(high)) - low) / (high - low)


def normal_key(x) -> Column:
    return F.lower(F.trim(_c(x).cast("string")))


def safe_name(x) -> Column:
    return F.regexp_replace(_c(x), "[^A-Za-z0-9]", "_")


def window_number(name, missing: int = 999) -> Column:
    """The number after _Win in a file name, or ``missing``."""
    return F.coalesce(F.regexp_extract(_c(name), r"(?i)_win(\d+)", 1).try_cast("int"), F.lit(missing))


def subject_name(name) -> Column:
    """A file or folder name without its stage suffixes and window number."""
    return F.regexp_replace(F.regexp_replace(_c(name), r"(?i)(_filtered|_avefeatures|_features|_feature)+$", ""), r"(?i)_win\d+.*$", "")


def sample_18bit(b0, b1, b2) -> Column:
    """An 18-bit reading of three bytes, the most significant first."""
    return F.shiftleft(_c(b0).cast("long"), 16).bitwiseOR(F.shiftleft(_c(b1).cast("long"), 8)).bitwiseOR(_c(b2).cast("long")).bitwiseAND(F.lit(0x3FFFF))


def finger_gate(x, ir, threshold: float = 50_000.0) -> Column:
    """0 where the finger is off."""
    return F.when(_c(ir) < threshold, F.lit(0.0)).otherwise(_c(x))


def close(a, b, relative: float = 1e-9) -> Column:
    """Equal within the tolerance; NULL equals NULL."""
    x, y = _c(a), _c(b)
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.abs(x - y) <= relative * F.greatest(F.abs(y), F.lit(1.0)))


def corrected_skewness(g1, n) -> Column:
    """G1 from the biased g1; NULL for fewer than three values."""
    n = _c(n).cast("double")
    return F.when(n > 2, _c(g1) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2, n) -> Column:
    """G2 from the biased excess g2; NULL for fewer than four values."""
    n = _c(n).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * _c(g2) + 6))
