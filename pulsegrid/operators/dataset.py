"""From subject features to a model-ready dataset: label join, cleaning, splitting, scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions import scalars
from pulsegrid.shared import discard, materialize


def first_match(labels: DataFrame, key: str, order: str) -> DataFrame:
    """One label a normalised key: the first in order."""
    k = labels.withColumn("_key", scalars.normal_key(key)).where("_key IS NOT NULL")
    best = k.groupBy("_key").agg(F.min_by(F.struct(*labels.columns), order).alias("_row"), F.count("*").alias("n_labels"))
    return best.select("_key", "n_labels", "_row.*")


def label_join(features: DataFrame, labels: DataFrame, feature_key: str, label_key: str, order: str, target: str) -> DataFrame:
    """features with the target of the first label whose trimmed, lower-case key equals theirs; NULL without one."""
    right = first_match(labels, label_key, order).select("_key", F.col(target).alias("target"), "n_labels")
    return features.withColumn("_key", scalars.normal_key(feature_key)).join(right, "_key", "left").drop("_key")


def unmatched(features: DataFrame, labels: DataFrame, feature_key: str, label_key: str) -> DataFrame:
    right = labels.select(scalars.normal_key(label_key).alias("_key")).distinct()
    return features.withColumn("_key", scalars.normal_key(feature_key)).join(right, "_key", "left_anti").drop("_key")


def failures(features: DataFrame, labels: DataFrame, feature_key: str, label_key: str, needed: Sequence[str] = ()) -> DataFrame:
    """name and reason of each feature row that gives no dataset row: no label has its key, or one of the needed values is missing."""
    right = labels.select(scalars.normal_key(label_key).alias("_key")).distinct().withColumn("_there", F.lit(True))
    both = features.withColumn("_key", scalars.normal_key(feature_key)).join(right, "_key", "left")
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull()
    reason = F.when(F.col("_there").isNull(), "no_metadata_match").when(missing, "no_feature_values")
    return both.select(F.col(feature_key).alias("name"), reason.alias("reason")).where("reason IS NOT NULL")


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, missing ones and their share."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    n = F.sum(F.col("value").isNull().cast("long"))
    return long.groupBy("feature").agg(F.count("*").alias("n_rows"), n.alias("n_null"), (100.0 * n / F.count("*")).alias("null_pct"))


def null_rows(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """feature and order of each missing value: a row a value, so that a column with many makes no long list."""
    long = df.select(order, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([order], list(columns), "feature", "value")
    return long.where(F.col("value").isNull()).select("feature", order)


def _joined(df: DataFrame, statistics: DataFrame) -> DataFrame:
    """df beside one row of statistics: a broadcast of exactly one row."""
    return df.crossJoin(F.broadcast(statistics))


#: Buckets a round of the search for an exact percentile, and the values at which it stops and sorts them.
BUCKETS, FEW = 4096, 20_000


@dataclass(frozen=True)
class _Interval:
    """Finite values of a column, of which ``ranks`` are sought; ``below`` values are smaller, ``n`` lie inside."""

    column: str
    low: float
    high: float
    below: int
    n: int
    ranks: tuple[int, ...]
    by_exponent: bool = False

    def bucket(self) -> Column:
        """A bucket number that grows with the value: of equal width, or sign and binary exponent."""
        x = F.col(self.column)
        if self.by_exponent:
            return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x))) + 1100)).cast("int")
        wide = math.isinf(self.high - self.low)  # then halves are far from the least numbers, and exact enough to stay in order
        f, low, high = (0.5, self.low / 2, self.high / 2) if wide else (1.0, self.low, self.high)
        return F.least(F.floor((x * f - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _ranks(rows: DataFrame, open_: list[_Interval]) -> dict[tuple[str, int], float]:
    """The values at the ranks (from 0) of the intervals' columns.

    Every round counts the values of an interval in buckets and goes on in the bucket that holds the rank, between the
    bucket's own least and largest value. Where buckets of equal width leave more than half of the values in one, the next
    round's are sign and exponent; inside one exponent four rounds of equal width separate any two numbers, so the search ends
    whatever the values. An interval of few values is sorted on the driver.
    """
    found: dict[tuple[str, int], float] = {}
    while open_:
        for v in (v for v in open_ if v.low == v.high):
            found |= {(v.column, r): v.low for r in v.ranks}
        jobs = [v for v in open_ if v.low < v.high]
        if not jobs:
            break
        few = [i for i, v in enumerate(jobs) if v.n <= FEW]
        parts = []
        for i, v in enumerate(jobs):
            x = F.col(v.column)
            parts.append(F.when(x.between(v.low, v.high), F.struct(F.lit(i).alias("i"), (F.lit(0) if i in few else v.bucket()).alias("b"), x.alias("x"))))
        cells = rows.select(F.explode(F.array(*parts)).alias("p")).where("p IS NOT NULL").select("p.*")
        values: dict[int, list[tuple[float, int]]] = {i: [] for i in few}
        if few:
            for r in cells.where(F.col("i").isin(few)).groupBy("i", "x").agg(F.count("*").alias("n")).collect():
                values[r.i].append((r.x, r.n))
        counts = cells.where(~F.col("i").isin(few)).groupBy("i", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect() if len(few) < len(jobs) else []
        open_ = []
        for i, v in enumerate(jobs):
            at = v.below
            if i in values:
                for x, n in sorted(values[i]):
                    found |= {(v.column, r): x for r in v.ranks if at <= r < at + n}
                    at += n
                continue
            for r in sorted((r for r in counts if r.i == i), key=lambda r: r.b):
                if mine := tuple(k for k in v.ranks if at <= k < at + r.n):
                    open_.append(_Interval(v.column, r.lo, r.hi, at, r.n, mine, not v.by_exponent and 2 * r.n > v.n))
                at += r.n
    return found


def percentiles(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact percentiles with linear interpolation, None for a column without values; infinities are values, NaN is none.

    The columns are written once and read in each round. No task and no buffer holds a column: the driver gets counts per
    bucket, whatever the rows and distinct values.
    """
    usable = lambda c: F.when(~F.isnan(c), c)
    rows = materialize(df.select(*[usable(F.col(c).cast("double")).alias(c) for c in columns]), "columns")
    top = F.lit(float("inf"))
    finite = lambda c: F.when(F.abs(c) < top, F.col(c))
    facts = [f.alias(f"{c}_{n}") for c in columns for n, f in (("n", F.count(c)), ("least", F.count_if(F.col(c) == -top)), ("most", F.count_if(F.col(c) == top)), ("lo", F.min(finite(c))), ("hi", F.max(finite(c))))]
    facts = rows.agg(*facts).first()
    found: dict[tuple[str, int], float] = {}
    open_ = []
    for c in columns:
        n, least, most = (facts[f"{c}_{k}"] for k in ("n", "least", "most"))
        ranks = sorted({f(p * (n - 1)) for p in points for f in (math.floor, math.ceil)}) if n else []
        found |= {(c, r): -math.inf for r in ranks if r < least} | {(c, r): math.inf for r in ranks if r >= n - most}
        if inner := tuple(r for r in ranks if least <= r < n - most):
            open_.append(_Interval(c, facts[f"{c}_lo"], facts[f"{c}_hi"], least, n - least - most, inner))
    found |= _ranks(rows, open_)
    discard(rows)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n, out[c] = facts[f"{c}_n"], []
        for p in points:
            at = p * (n - 1) if n else 0
            a, b = (found[c, math.floor(at)], found[c, math.ceil(at)]) if n else (None, None)
            out[c].append(a if a is None or a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """The same as one row: <column>_q<i>."""
    found = percentiles(df, columns, points)
    return df.sparkSession.range(1).select(*[F.lit(found[c][i]).cast("double").alias(f"{c}_q{i}") for c in columns for i in range(len(points))])


def drop_unlabelled(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def impute(df: DataFrame, columns: Sequence[str], fallback: float | None = None) -> DataFrame:
    """Missing values take their column's median, or the fallback where the column has none."""
    medians = percentiles(df, columns, (0.5,))
    fill = lambda c: F.coalesce(F.col(c), F.lit(medians[c][0] if medians[c][0] is not None else fallback).cast("double"))
    return df.select(*[fill(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def fences(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Per column: quartiles, IQR, lower and upper fence."""
    q = quantiles(df, columns, (0.25, 0.75))
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_q0").alias("q1"), F.col(f"{c}_q1").alias("q3")) for c in columns]
    long = q.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("iqr", F.col("q3") - F.col("q1"))
    return long.withColumn("low", F.col("q1") - factor * F.col("iqr")).withColumn("high", F.col("q3") + factor * F.col("iqr"))


def clip_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Values beyond the fences become the fences."""
    both = _joined(df, quantiles(df, columns, (0.25, 0.75)))

    def clipped(c: str) -> Column:
        q1, q3 = F.col(f"{c}_q0"), F.col(f"{c}_q1")
        return scalars.clip(c, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))

    return both.select(*[clipped(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Per column: values outside the fences of the data as they are."""
    both = _joined(df, quantiles(df, columns, (0.25, 0.75)))
    out = []
    for c in columns:
        q1, q3 = F.col(f"{c}_q0"), F.col(f"{c}_q1")
        out.append(F.count_if((F.col(c) < q1 - factor * (q3 - q1)) | (F.col(c) > q3 + factor * (q3 - q1))).alias(c))
    return both.agg(*out).unpivot([], list(columns), "feature", "n_outliers")


#: The chosen rows of a split are broadcast up to so many.
CHOSEN = 100_000


def stratified_split(df: DataFrame, stratum: str, quotas: dict[int, int], order: Sequence[Column | str], forced: Column | None = None) -> DataFrame:
    """Adds split: the first ``quota`` rows of each stratum in order are test (forced ones first), the rest train.

    No stratum is sorted or sent to one task: each task keeps the best rows of a stratum up to its quota, and only these
    meet. The rows are written first, so that those chosen are known by their number; they are broadcast if the quotas sum
    to at most ``CHOSEN``.
    """
    wanted = {k: q for k, q in quotas.items() if q > 0}
    if not wanted:
        return df.withColumn("split", F.lit("train"))
    keys = [F.coalesce((~forced).cast("int"), F.lit(1)).alias("_k")] if forced is not None else []
    keys += [(F.col(c) if isinstance(c, str) else c).alias(f"_k{i}") for i, c in enumerate(order)]
    rows = materialize(df.select("*", F.struct(*keys).alias("_order")).withColumn("_row", F.monotonically_increasing_id()), "split")
    best = Window.partitionBy(stratum).orderBy("_order", "_row")
    quota = F.element_at(F.create_map(*[F.lit(x) for k, q in wanted.items() for x in (k, q)]), F.col(stratum))
    mine = rows.where(F.col(stratum).isin(list(wanted))).select("_row", stratum, "_order")
    # a constant bound on the row number lets every task drop what is beyond it before anything is moved
    ranked = mine.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= max(wanted.values()))
    chosen = ranked.where(F.col("_n") <= quota).select("_row", F.lit("test").alias("_split"))
    chosen = F.broadcast(chosen) if sum(wanted.values()) <= CHOSEN else chosen
    out = rows.join(chosen, "_row", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_split", F.lit("train")).alias("split"))


@dataclass(frozen=True)
class SplitPlan:
    """Settings of a split: rows of both sides, the strata's edges and names, test rows per name, forced row numbers from 1."""

    n_train: int
    n_test: int
    edges: tuple[float, ...]
    names: tuple[int, ...]
    quotas: dict[int, int]
    forced: tuple[int, ...] = ()


def check_split(df: DataFrame, stratum: str, plan: SplitPlan) -> DataFrame:
    """What is wrong with a plan for these data, as rows (step, problem) of six checks; none if it can be carried out.

    1 both sides make up the table; 2 a name for each pair of edges; 3 a quota for each name and no other; 4 quotas add up to
    the test rows; 5 forced rows are rows of the table, each once, and not more than test rows; 6 strata have their quota.
    """
    named = F.col(stratum).isin(list(plan.names))
    counts = {r[0]: r[1] for r in df.groupBy(F.when(named, F.col(stratum)).alias("name")).count().collect()}
    total, quotas = sum(counts.values()), plan.quotas
    wrong: list[tuple[int, str]] = []
    if plan.n_train + plan.n_test != total:
        wrong.append((1, f"train {plan.n_train} and test {plan.n_test} rows of {total}"))
    if len(plan.names) != len(plan.edges) - 1:
        wrong.append((2, f"{len(plan.names)} names for {len(plan.edges) - 1} strata"))
    wrong += [(3, f"no quota for {k}") for k in plan.names if k not in quotas]
    wrong += [(3, f"quota for unknown {k}") for k in quotas if k not in plan.names]
    if (given := sum(quotas.get(k, 0) for k in plan.names)) != plan.n_test:
        wrong.append((4, f"quotas sum to {given}, not {plan.n_test}"))
    wrong += [(5, f"forced row {r} of {total}") for r in plan.forced if not 1 <= r <= total]
    if len(set(plan.forced)) < len(plan.forced):
        wrong.append((5, "forced rows repeat"))
    if len(plan.forced) > plan.n_test:
        wrong.append((5, f"{len(plan.forced)} forced rows for {plan.n_test} test rows"))
    wrong += [(6, f"stratum {k}: {quotas[k]} of {counts.get(k, 0)} rows") for k in plan.names if quotas.get(k, 0) > counts.get(k, 0)]
    return df.sparkSession.createDataFrame(wrong, "step int, problem string")


def folds(df: DataFrame, k: int, order: Sequence[Column | str], groups: int = 1024, group: Column | str | None = None) -> DataFrame:
    """Adds fold 0..k-1. Rows are numbered in order within groups (by default ``groups`` of a hash), so that no task sorts
    the whole table; the groups start with different folds. group: a whole number, with which each group's folds begin."""
    g = F.pmod(F.xxhash64(*[c for c in order]), groups) if group is None else F.col(group) if isinstance(group, str) else group
    hashed = df.withColumn("_g", g)
    n = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    return hashed.withColumn("fold", ((n - 1 + F.col("_g")) % k).cast("int")).drop("_g")


def scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, center (median), scale (interquartile range) of the training rows."""
    q = quantiles(train, columns, (0.25, 0.5, 0.75))
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_q1").alias("center"), (F.col(f"{c}_q2") - F.col(f"{c}_q0")).alias("scale")) for c in columns]
    return q.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scale(df: DataFrame, parameters: DataFrame, columns: Sequence[str], dialect: str = "offline") -> DataFrame:
    """(x - center) / scale. Where the scale is 0: offline divides by 1, inference keeps x, service gives 0.

    parameters has one row a feature; they become one row of columns.
    """
    wide = parameters.groupBy().pivot("feature", list(columns)).agg(F.first("center").alias("center"), F.first("scale").alias("scale"))
    both = _joined(df, wide)

    def scaled(c: str) -> Column:
        x, m, s = F.col(c), F.col(f"{c}_center"), F.col(f"{c}_scale")
        flat = {"offline": x - m, "inference": x, "service": F.when(x.isNotNull(), F.lit(0.0))}[dialect]
        return F.when(s.isNull(), x if dialect != "offline" else F.lit(None)).when(s == 0, flat).otherwise((x - m) / s)

    return both.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are NULL there."""
    return a.unionByName(b, allowMissingColumns=True)


def complement(df: DataFrame, part: DataFrame, key: str) -> DataFrame:
    return df.join(part.select(key).distinct(), key, "left_anti")


def update_rows(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """rows, with the non-null values of the update that has their key; columns of updates that are new are added."""
    new = [c for c in updates.columns if c != key]
    right = updates.withColumnsRenamed({c: f"_new_{c}" for c in new})
    both = rows.join(right, key, "left")
    old = [F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in rows.columns]
    return both.select(*old, *[F.col(f"_new_{c}").alias(c) for c in new if c not in rows.columns])


def cleaning_facts(df: DataFrame, columns: Sequence[str], target: str, factor: float = 1.5) -> DataFrame:
    """One row about a cleaning: rows, rows without target, and per column the missing values and those clipped."""
    f = percentiles(df.where(F.col(target).isNotNull()), columns, (0.25, 0.75))
    rows = [F.count("*").alias("n_rows"), F.count_if(F.col(target).isNull()).alias("n_unlabelled")]
    for c in columns:
        q1, q3 = f[c]
        beyond = F.lit(False) if q1 is None else (F.col(c) < q1 - factor * (q3 - q1)) | (F.col(c) > q3 + factor * (q3 - q1))
        rows += [F.count_if(F.col(c).isNull() & F.col(target).isNotNull()).alias(f"{c}_missing"), F.count_if(beyond & F.col(target).isNotNull()).alias(f"{c}_clipped")]
    return df.agg(*rows)


def split_facts(split: DataFrame, stratum: str) -> DataFrame:
    """Rows of each side of a split, per stratum."""
    return split.groupBy(stratum).agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))


def summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, extremes, mean, spread and median of a column per group. The median is that of Spark's exact aggregate: groups are bounded here (windows, subjects)."""
    c = F.col(column)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.median(c).alias("med"))


def consistency(df: DataFrame, group: str, settings: Sequence[str]) -> DataFrame:
    """Per group: rows, different settings among them, and whether there is more than one."""
    n = F.count_distinct(F.to_json(F.struct(*settings), {"ignoreNullFields": "false"}))
    return df.groupBy(group).agg(F.count("*").alias("n"), n.alias("n_settings"), (n > 1).alias("mixed"))
