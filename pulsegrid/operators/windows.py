"""Order and windows: numbering of samples, slicing into fixed windows, collecting them as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.config import Sampling


def number_rows(df: DataFrame, key: str, time: str, ties: tuple[str, ...] = (), part: str = "day", name: str = "seq") -> DataFrame:
    """Adds ``name``: 1, 2, ... within each key in time order.

    Counts per (key, day) are summed over the days first, and rows are numbered within their day: a key with a third of
    all rows is spread over its days and never sorted in one task. Rows without key or time have no place and are left out.
    """
    cut = df.withColumn("_part", F.date_trunc(part, F.col(time).cast("timestamp")))
    counts = cut.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_part").orderBy(time, *ties)
    out = cut.join(starts, [key, "_part"]).withColumn(name, F.col("_start") + F.row_number().over(inside))
    return out.drop("_part", "_start")


def cut_windows(df: DataFrame, size: int, key: str = "subject_id", seq: str = "seq", complete: bool = True) -> DataFrame:
    """Adds win and i (both from 0): non-overlapping windows of ``size`` rows; an incomplete last one is dropped."""
    out = df.withColumn("win", F.floor((F.col(seq) - 1) / size).cast("long")).withColumn("i", (F.col(seq) - 1) % size)
    if complete:
        per = Window.partitionBy(key, "win")
        out = out.withColumn("_n", F.count("*").over(per)).where(F.col("_n") == size).drop("_n")
    return out


def slice_ranges(df: DataFrame, ranges: DataFrame, hertz: float, key: str = "subject_id", seq: str = "seq") -> DataFrame:
    """Windows named by hand: ranges has key, win, start_s and end_s; rows with int(start fs) < seq <= int(end fs).

    An end of 0 is the end of the recording: 0, 0 is all of it."""
    r = ranges.select(key, "win", F.floor(F.col("start_s") * hertz).alias("_a"), F.when(F.col("end_s") > 0, F.floor(F.col("end_s") * hertz)).alias("_b"))
    out = df.join(r, key).where((F.col(seq) > F.col("_a")) & (F.col("_b").isNull() | (F.col(seq) <= F.col("_b"))))
    return out.withColumn("i", F.col(seq) - 1 - F.col("_a")).drop("_a", "_b")


def collect_windows(df: DataFrame, channels: tuple[str, ...] = ("ir", "red"), key: str = "subject_id") -> DataFrame:
    """One row a window, its samples as arrays in order. A window is bounded, so its group is."""
    rows = df.groupBy(key, "win").agg(F.array_sort(F.collect_list(F.struct("i", *channels))).alias("_s"))
    return rows.select(key, "win", F.size("_s").alias("n"), *[F.col(f"_s.{c}").alias(c) for c in channels])


def automatic_windows(df: DataFrame, sampling: Sampling | None = None, channels: tuple[str, ...] = ("ir", "red"), key: str = "subject_id") -> DataFrame:
    """Whole windows of each subject; with none and at least half a window of samples, one padded with its last sample."""
    size = (sampling or Sampling()).window
    cut = cut_windows(df, size, key, complete=False)
    rows = collect_windows(cut, channels, key)
    whole = rows.where(F.col("n") == size)
    short = rows.where((F.col("win") == 0) & (F.col("n") < size) & (F.col("n") >= size // 2))
    filled = [F.concat(F.col(c), F.array_repeat(F.element_at(c, -1), F.lit(size) - F.size(c))).alias(c) for c in channels]
    return whole.unionByName(short.select(key, "win", F.lit(size).alias("n"), *filled))


def valid(df: DataFrame, red: float = 0.0, ir: float = 0.0) -> DataFrame:
    """Rows with both channels above their thresholds."""
    return df.where((F.col("red") > red) & (F.col("ir") > ir))


def tail(df: DataFrame, n: int, key: str = "subject_id", seq: str = "seq") -> DataFrame:
    """The last n rows of each key."""
    last = df.groupBy(key).agg(F.max(seq).alias("_last"))
    return df.join(last, key).where(F.col(seq) > F.col("_last") - n).drop("_last")


def fill_gaps(df: DataFrame, column: str, key: str = "subject_id", order: str = "seq", block: int = 1 << 16) -> DataFrame:
    """Missing values take the last one before, at the start the first one after. order: a whole number.

    Blocks of the order are filled by themselves; what enters a block from others comes from one row a block.
    """
    c = F.col(column)
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    there = F.when(c.isNotNull(), F.col(order))
    ends = cut.groupBy(key, "_block").agg(F.max_by(c, there).alias("_last"), F.min_by(c, there).alias("_first"))
    blocks = Window.partitionBy(key).orderBy("_block")
    before = F.last("_last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing))
    joined = cut.join(ends.select(key, "_block", before.alias("_before"), after.alias("_after")), [key, "_block"])
    inside = Window.partitionBy(key, "_block").orderBy(order)
    back = F.last(column, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(column, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    return joined.withColumn(column, F.coalesce(back, "_before", ahead, "_after")).drop("_block", "_before", "_after")


def relative_seconds(df: DataFrame, text: str, key: str = "subject_id", order: str = "seq", hertz: float = 400.0, name: str = "ts") -> DataFrame:
    """Seconds since the first sample: of numbers, else of times (gaps filled, if at most half are bad), else seq / fs."""
    when = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.col(text))))
    d = df.withColumn("_num", F.col(text).try_cast("double")).withColumn("_sec", F.unix_micros(when) / 1e6)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    facts = d.groupBy(key).agg(F.count("*").alias("_all"), F.count("_num").alias("_nn"), F.count("_sec").alias("_ns"), first("_num").alias("_num0"), first("_sec").alias("_sec0"))
    d = fill_gaps(d, "_sec", key, order).join(facts, key)
    value = (
        F.when(F.col("_nn") == F.col("_all"), F.col("_num") - F.col("_num0"))
        .when(F.col("_ns") * 2 >= F.col("_all"), F.col("_sec") - F.col("_sec0"))
        .otherwise((F.col(order) - 1) / hertz)
    )
    return d.withColumn(name, value).drop("_num", "_sec", "_all", "_nn", "_ns", "_num0", "_sec0")


def per_window(key: str = "subject_id") -> Column:
    return Window.partitionBy(key, "win").orderBy("i")
