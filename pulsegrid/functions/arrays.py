"""Array expressions over whole windows or beats, built from higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, b: a + b)


def trapezoid(x) -> Column:
    """Area under unit-spaced samples."""
    a = _c(x)
    return total(a) - (F.get(a, F.lit(0)) + F.get(a, F.size(a) - 1)) / 2


def pad(x, length: int) -> Column:
    """NULLs up to the length."""
    a = _c(x)
    return F.concat(a, F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.lit(length) - F.size(a))))


def shift_hold(x, by: int) -> Column:
    """Shifted by some samples, the edge value held."""
    a = _c(x)
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, F.greatest(F.lit(0), F.least(n - 1, i - by))))


def resample(x, points: int) -> Column:
    """Linear interpolation at ``points`` evenly spaced places."""
    a = _c(x)
    last = F.size(a) - 1

    def at(i: Column) -> Column:
        p = i.cast("double") * last / (points - 1)
        k = F.least(F.floor(p).cast("int"), F.greatest(last - 1, F.lit(0)))
        low = F.get(a, k)
        return low + (F.coalesce(F.get(a, k + 1), low) - low) * (p - k)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def spread(x) -> Column:
    return F.array_max(_c(x)) - F.array_min(_c(x))


def first_index_of_max(x) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(_c(x), F.array_max(_c(x))) - 1


def trailing(x, n: int) -> Column:
    a = _c(x)
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), n)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def fir(x, kernel: Sequence[float], at: Column) -> Column:
    """The symmetric filter ``kernel`` (odd length) centred at place ``at``; beyond the ends the edge value holds."""
    a, h = _c(x), len(kernel) // 2
    place = lambda k: F.greatest(F.lit(0), F.least(F.size(a) - 1, at + k - h))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(kernel) - 1)), F.lit(0.0), lambda s, k: s + F.get(_numbers(kernel), k) * F.get(a, place(k)))


def savgol(x, window: int, degree: int) -> Column:
    """Least-squares smoothing as dot products: inner samples by the middle row of the projection matrix of a window, the ends by
    the other rows over the first and the last window. window: odd; NULL for arrays that are not longer."""
    a, h = _c(x), window // 2
    basis = np.vander(np.arange(-h, h + 1), degree + 1, increasing=True).astype(float)
    rows = F.array(*[_numbers(r) for r in basis @ np.linalg.pinv(basis)])
    n = F.size(a)

    def at(i: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(n - window, i - h))
        return dot(F.slice(a, start + 1, window), F.get(rows, i - start))

    return F.when(n > window, F.transform(F.sequence(F.lit(0), n - 1), at))


def gradient(x, times: float = 1.0) -> Column:
    """Central differences, one-sided at the ends."""
    a = _c(x)
    n = F.size(a)

    def at(i: Column) -> Column:
        before, after = F.greatest(F.lit(0), i - 1), F.least(n - 1, i + 1)
        return (F.get(a, after) - F.get(a, before)) / (after - before) * times

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def let(value: Column, f) -> Column:
    """f of the value, which is computed once however often f reads it: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shannon(x, bins: int = 64) -> Column:
    """Entropy in bits of the histogram over the array's range; 0 for a constant."""

    def of_ends(ends: Column, n: Column) -> Column:
        share = F.transform(ends, lambda e, k: (e - F.when(k > 0, F.get(ends, k - 1)).otherwise(0)) / n)
        return -F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(p)) + 0.0

    def of_ordered(ordered: Column) -> Column:
        # a run of equal bins ends where the next bin differs; its length is the distance of two ends
        n = F.size(ordered)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(ends, lambda e: of_ends(e, n))

    def of_range(r: Column) -> Column:
        low, high = r["low"], r["high"]
        bin_of = F.transform(_c(x), lambda v: F.when(high > low, F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(0))
        return let(F.array_sort(bin_of), of_ordered)

    return let(F.struct(F.array_min(_c(x)).alias("low"), F.array_max(_c(x)).alias("high")), of_range)
