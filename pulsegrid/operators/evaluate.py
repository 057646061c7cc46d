"""How good predictions are: errors, ranges, zones, importance, tree shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.config import BIN_EDGES
from pulsegrid.functions import scalars


def metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 (NULL below two rows or without variance) and MAPE, in one pass."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.count("*") >= 2, 1 - F.try_divide(F.sum(e * e), total)).alias("r2"), (100 * F.avg(F.try_divide(F.abs(e), F.abs(y)))).alias("mape"),
    )


def per_range(df: DataFrame, actual: str, predicted: str, edges: Sequence[float] = BIN_EDGES) -> DataFrame:
    """Rows, mean and largest absolute error per left-closed range; all ranges appear."""
    e = F.abs(F.col(actual) - F.col(predicted))
    found = df.groupBy(scalars.range_left(actual, edges).alias("range_id")).agg(F.count("*").alias("n"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"))
    names = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("range_id"))
    out = names.join(found, "range_id", "left")
    return out.select("range_id", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean_error", 2).alias("mean_error"), F.round("max_error", 2).alias("max_error"))


def zone_a(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows within 20 % of the reference, and their share."""
    inside = F.count_if(F.abs(F.col(predicted) - F.col(actual)) <= 0.2 * F.col(actual))
    return df.agg(F.count("*").alias("n"), inside.alias("n_zone_a"), (100.0 * inside / F.count("*")).alias("zone_a_pct"))


def importance_table(df: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Rank, percentage and cumulative percentage of rounded shares. One row a feature: the only global window here."""
    every = Window.partitionBy(F.lit(0))
    ranked = every.orderBy(F.desc(value), feature)
    out = df.withColumn("rank", F.row_number().over(ranked).cast("long"))
    out = out.withColumn("percentage", F.round(100 * scalars.safe_ratio(F.col(value), F.sum(value).over(every)), 2))
    return out.withColumn("cumulative", F.round(F.sum("percentage").over(ranked.rowsBetween(Window.unboundedPreceding, 0)), 2))


def at_least(df: DataFrame, share: float, value: str = "importance") -> DataFrame:
    """Features with at least this share of the total."""
    return df.withColumn("_share", scalars.safe_ratio(F.col(value), F.sum(value).over(Window.partitionBy(F.lit(0))))).where(F.col("_share") >= share).drop("_share")


def unused(df: DataFrame, features: Sequence[str], feature: str = "feature", value: str = "importance") -> DataFrame:
    """The features that a model did not use: absent from its importances, or at zero."""
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias(feature))
    return every.join(df.where(F.col(value) > 0).select(feature), feature, "left_anti")


def distribution(df: DataFrame, name: Column, names: Sequence[str]) -> DataFrame:
    """Rows per class, all classes present."""
    found = df.groupBy(name.alias("class")).agg(F.count("*").alias("n"))
    rows = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in names])).alias("class"))
    return rows.join(found, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def tree_depths(nodes: DataFrame, deepest: int = 32) -> DataFrame:
    """Adds depth to a node table (tree, node, yes, no ...): one join a level, until no node is left."""
    level = nodes.where("node = 0").select("tree", "node", F.lit(0).alias("depth"))
    out = level
    links = nodes.select("tree", F.col("node").alias("_parent"), F.explode(F.array("yes", "no")).alias("_child")).where("_child IS NOT NULL")
    for d in range(1, deepest):
        level = links.join(level.select("tree", F.col("node").alias("_parent")), ["tree", "_parent"]).select("tree", F.col("_child").alias("node"), F.lit(d).alias("depth"))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return nodes.join(out, ["tree", "node"])


def topology(nodes: DataFrame) -> DataFrame:
    """Per tree: nodes, leaves, depth, mean leaf value."""
    d = tree_depths(nodes)
    leaf = F.col("yes").isNull()
    return d.groupBy("tree").agg(F.count("*").alias("n_nodes"), F.count_if(leaf).alias("n_leaves"), F.max("depth").alias("depth"), F.avg(F.when(leaf, F.col("leaf"))).alias("mean_leaf"))


def node_importance(nodes: DataFrame) -> DataFrame:
    """Per feature: splits, total and mean gain, mean cover."""
    inner = nodes.where("yes IS NOT NULL")
    return inner.groupBy("feature").agg(F.count("*").alias("weight"), F.sum("gain").alias("total_gain"), F.avg("gain").alias("importance"), F.avg("cover").alias("cover"))


def selected(importances: DataFrame, mask: dict[str, int] | None = None, top: int | None = None, least_share: float | None = None, value: str = "importance") -> DataFrame:
    """Features to keep: those of a 0/1 mask (in its order, missing ones at importance 0), the top n, or by share."""
    if mask is not None:
        wanted = [(i, f) for i, (f, on) in enumerate(mask.items()) if on]
        rows = importances.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("feature")) for i, f in wanted])).alias("r")).select("r.*")
        return rows.join(importances, "feature", "left").select("place", "feature", F.coalesce(value, F.lit(0.0)).alias(value))
    rows = importances if least_share is None else at_least(importances, least_share, value)
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(value), "feature")) - 1)
    return (ranked if top is None else ranked.where(F.col("place") < top)).select("place", "feature", value)


def single_point(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Signed, absolute and percentage error and zone of each prediction that has a reference."""
    e = F.col(predicted) - F.col(actual)
    return df.select("*", e.alias("error"), F.abs(e).alias("abs_error"), scalars.safe_ratio(100 * F.abs(e), F.abs(F.col(actual))).alias("percent_error"), scalars.clarke_zone(actual, predicted).alias("zone"))
