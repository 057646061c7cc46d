"""Sample-wise operators in long form, as analytic expressions over one ordered window.

Every function takes the window specification ``w`` (partition and order of one signal), so that several of them in
one select share a single sort.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pulsegrid.functions import arrays


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def median3(x, w: WindowSpec) -> Column:
    """Median of three; outside the signal lie zeros."""
    x = _c(x)
    a, b, c = F.lag(x, 1, 0.0).over(w), x, F.lead(x, 1, 0.0).over(w)
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def gradient(x, w: WindowSpec) -> Column:
    """Central differences, one-sided at the ends."""
    x = _c(x)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def weighted(x, coefficients: Sequence[float], w: WindowSpec) -> Column:
    """A symmetric filter of odd length; NULL where it would reach outside."""
    x, h = _c(x), len(coefficients) // 2
    terms = [F.lag(x, -k).over(w) * c if k < 0 else (x * c if k == 0 else F.lead(x, k).over(w) * c) for k, c in zip(range(-h, h + 1), coefficients, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def energy(x, w: WindowSpec) -> Column:
    """x[n]^2 - x[n-1] x[n+1]; NULL at the ends."""
    x = _c(x)
    return x * x - F.lag(x).over(w) * F.lead(x).over(w)


def sign_change(x, w: WindowSpec) -> Column:
    """1 where the sign bit differs from the previous sample's."""
    x = _c(x)
    return F.when((x < 0) != (F.lag(x).over(w) < 0), 1).otherwise(0)


def product_change(x, w: WindowSpec) -> Column:
    """1 where the product with the previous sample is negative: a zero in between does not count."""
    x = _c(x)
    return F.when(x * F.lag(x).over(w) < 0, 1).otherwise(0)


def minmax(x, whole: WindowSpec) -> Column:
    x = _c(x)
    low, high = F.min(x).over(whole), F.max(x).over(whole)
    return F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))


def zscore(x, whole: WindowSpec) -> Column:
    x = _c(x)
    return F.coalesce(F.try_divide(x - F.avg(x).over(whole), F.stddev_pop(x).over(whole)), F.lit(0.0))


def is_peak(x, w: WindowSpec) -> Column:
    """A strict local maximum."""
    x = _c(x)
    return F.coalesce((x > F.lag(x).over(w)) & (x > F.lead(x).over(w)), F.lit(False))


def is_valley(x, w: WindowSpec) -> Column:
    x = _c(x)
    return F.coalesce((x < F.lag(x).over(w)) & (x < F.lead(x).over(w)), F.lit(False))


def last_before(flag: Column, value, w: WindowSpec) -> Column:
    """As-of lookup: the value of the latest earlier row that has the flag."""
    return F.last(F.when(flag, _c(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def first_from(flag: Column, value, w: WindowSpec, ahead: int = 0) -> Column:
    """Range lookup: the value of the first row that has the flag, from ``ahead`` rows after this one on."""
    return F.first(F.when(flag, _c(value)), ignorenulls=True).over(w.rowsBetween(ahead, Window.unboundedFollowing))


def bin64(x, whole: WindowSpec, bins: int = 64) -> Column:
    """Equal-width bin over the window's range, the last one closed."""
    x = _c(x)
    low, high = F.min(x).over(whole), F.max(x).over(whole)
    return F.least(F.floor(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long")


def smoothed_derivatives(windows: DataFrame, x: str, fs: float) -> DataFrame:
    """windows with velocity and acceleration of the array x: smoothing and differences in turn, each a column of its own, so that
    no step is computed again for every sample of the next."""
    long, short = (max(7, int(0.05 * fs)), max(5, int(0.03 * fs)))
    long, short = long + 1 - long % 2, short + 1 - short % 2
    d = windows.withColumn("_s", arrays.savgol(x, long, 3)).withColumn("_g", arrays.gradient("_s", fs))
    d = d.withColumn("velocity", arrays.savgol("_g", short, 2)).withColumn("_h", arrays.gradient("velocity", fs))
    return d.withColumn("acceleration", arrays.savgol("_h", short, 2)).drop("_s", "_g", "_h")


def lowpass_kernel(by: int, taps: int = 101) -> np.ndarray:
    """A windowed sinc (Hamming) that passes what is below the half of a rate ``by`` times lower; its sum is 1."""
    i = np.arange(-(taps // 2), taps // 2 + 1)
    kernel = np.sinc(i / by) / by * (0.54 + 0.46 * np.cos(np.pi * i / (taps // 2)))
    return kernel / kernel.sum()


def decimated(readings: DataFrame, by: int, taps: int = 101, channels: Sequence[str] = ("ir", "red"), block: int = 1 << 13, key: str = "subject_id", seq: str = "seq") -> DataFrame:
    """Every ``by``-th sample of each recording after a low-pass without delay: key, seq (from 1) and the channels.

    readings: samples numbered from 1 without gaps. A recording is cut into blocks of its numbers, and each block also gets
    the ``taps // 2`` samples before and after it; blocks are filtered by themselves, and their size changes no result. Beyond the ends
    of a recording its edge values hold.
    """
    h, place = taps // 2, F.col(seq) - 1
    own = lambda x: F.floor(x / block).cast("long")
    blocks = F.filter(F.sequence(own(place - h), own(place + h)), lambda b: b >= 0)
    rows = readings.select(key, place.cast("long").alias("_at"), *channels, F.explode(blocks).alias("_block"))
    held = rows.groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct("_at", *channels))).alias("_x"))
    held = held.select(key, "_block", F.col("_x._at").alias("_at"), *[F.col(f"_x.{c}").alias(f"_{c}") for c in channels])
    mine = F.filter(F.sequence(F.lit(0), F.size("_at") - 1), lambda i: (own(F.get("_at", i)) == F.col("_block")) & (F.get("_at", i) % by == 0))
    picked = held.select(key, "_at", *[f"_{c}" for c in channels], F.explode(mine).alias("_i"))
    kernel = lowpass_kernel(by, taps).tolist()
    return picked.select(key, (F.get("_at", F.col("_i")) / by + 1).cast("long").alias("seq"), *[arrays.fir(f"_{c}", kernel, F.col("_i")).alias(c) for c in channels])
