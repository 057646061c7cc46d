"""Dataset, model and store operators on the driver tables.

Customers are subjects with c_acctbal / 30 as reference value; orders are predictions of it; parts and line items give
feature columns. Missing values are made in the query.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.config import Boosting
from pulsegrid.functions import scalars
from pulsegrid.operators import boost, dataset, evaluate, store
from pulsegrid.plans.registry import query, table

CUST = "WITH cu AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal / 30 END AS y, c_nationkey FROM customer)"
FEAT = "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END AS a, l_extendedprice AS b, l_discount * 100 AS d, l_returnflag FROM lineitem)"
PRED = "WITH p AS (SELECT o_orderkey, o_custkey, 40 + (o_orderkey * 37 % 3600) / 10.0 AS y, 40 + (o_orderkey * 37 % 3600) / 10.0 + (o_orderkey * 53 % 1201 - 600) / 10.0 AS yhat FROM orders)"
COLUMNS = ["a", "b", "d"]


def customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal") / 30).alias("y"), "c_nationkey")


def features(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 13 != 0, F.col("l_quantity")).alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_discount") * 100).alias("d"), "l_returnflag")


def predictions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y = 40 + (F.col("o_orderkey") * 37 % 3600) / 10.0
    return o.select("o_orderkey", "o_custkey", y.alias("y"), (y + (F.col("o_orderkey") * 53 % 1201 - 600) / 10.0).alias("yhat"))


KEYED = """, l AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN '  NATION_' || s_nationkey || ' ' ELSE 'nation_' || s_nationkey END AS label_key, s_suppkey AS label_seq, s_acctbal AS target FROM supplier WHERE s_nationkey < 20),
r AS (SELECT lower(trim(label_key)) AS k, target, row_number() OVER (PARTITION BY lower(trim(label_key)) ORDER BY label_seq) AS rn, count(*) OVER (PARTITION BY lower(trim(label_key))) AS n_labels FROM l)"""
N = "WITH n AS (SELECT * FROM nation)"


def label_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_nationkey < 20")
    k = F.col("s_nationkey").cast("string")
    return s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("  NATION_"), k, F.lit(" "))).otherwise(F.concat(F.lit("nation_"), k)).alias("label_key"), F.col("s_suppkey").alias("label_seq"), F.col("s_acctbal").alias("target"))


@query(N + KEYED + " SELECT n_nationkey, n_name, target, n_labels FROM n LEFT JOIN r ON lower(trim(n_name)) = k AND rn = 1")
def label_join_first_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return dataset.label_join(n, label_rows(spark, sf_dir), "n_name", "label_key", "label_seq", "target").select("n_nationkey", "n_name", "target", "n_labels")


@query(N + KEYED + " SELECT n_nationkey, n_name FROM n WHERE lower(trim(n_name)) NOT IN (SELECT k FROM r)")
def label_unmatched(spark, sf_dir):
    return dataset.unmatched(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), label_rows(spark, sf_dir), "n_name", "label_key")


@query(CUST + " SELECT o_orderkey AS id, c_custkey AS subject_id, c_name AS name, y AS glucose_level, o_totalprice AS predicted FROM orders JOIN cu ON o_custkey = c_custkey WHERE y IS NOT NULL")
def predicted_vs_actual(spark, sf_dir):
    s = customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("y").alias("glucose_level"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), F.col("o_totalprice").alias("predicted"), F.col("o_orderdate").alias("created_at"))
    return store.predicted_vs_actual(s, p).select("id", "subject_id", "name", "glucose_level", "predicted")


@query(PRED + " SELECT (SELECT count(*) FROM customer) AS n_subjects, count(*) AS n_predictions, round(avg(yhat), 6) AS mean_predicted, round(avg(abs(yhat - y)), 6) AS mae FROM p")
def dashboard_stats(spark, sf_dir):
    p = predictions(spark, sf_dir).select(F.col("yhat").alias("predicted"), F.col("y").alias("actual"))
    d = store.dashboard(table(spark, sf_dir, "customer"), p)
    return d.select("n_subjects", "n_predictions", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("mae", 6).alias("mae"))


CLASSES = "CASE WHEN {x} < 70 THEN 'Hypoglycemic' WHEN {x} <= 100 THEN 'Normal' WHEN {x} <= 125 THEN 'Pre-diabetic' WHEN {x} <= 180 THEN 'Diabetic' WHEN {x} IS NOT NULL THEN 'Hyperglycemic' END"


@query(PRED + f", k AS (SELECT {CLASSES.format(x='yhat')} AS class, count(*) AS n FROM p GROUP BY ALL) SELECT t.class, coalesce(n, 0) AS n FROM (SELECT unnest(['Hypoglycemic', 'Normal', 'Pre-diabetic', 'Diabetic', 'Hyperglycemic']) AS class) t LEFT JOIN k USING (class)")
def class_distribution(spark, sf_dir):
    return store.class_counts(predictions(spark, sf_dir).select(F.col("yhat").alias("predicted")))


@query(PRED + " SELECT o_orderkey, o_custkey, y FROM p WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 5")
def latest_predictions(spark, sf_dir):
    p = predictions(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), "y", F.col("o_orderkey").alias("created_at"))
    return store.latest(p, 7, 5).select(F.col("id").alias("o_orderkey"), F.col("subject_id").alias("o_custkey"), "y")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(FEAT + " SELECT feature, count(*) AS n_rows, count(*) - count(v) AS n_null, round(100.0 * (count(*) - count(v)) / count(*), 6) AS null_pct FROM (SELECT unnest(['a', 'b', 'd']) AS feature, unnest([a, b, d]) AS v FROM f) GROUP BY ALL")
def null_profile(spark, sf_dir):
    p = dataset.null_profile(features(spark, sf_dir), COLUMNS)
    return p.select("feature", "n_rows", "n_null", F.round("null_pct", 6).alias("null_pct"))


@query(FEAT + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(a, (SELECT quantile_cont(a, 0.5) FROM f)) AS a, b, d FROM f")
def median_impute(spark, sf_dir):
    return dataset.impute(features(spark, sf_dir).drop("l_returnflag"), COLUMNS)


Q = "SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.75) AS a3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.75) AS b3, quantile_cont(d, 0.25) AS d1, quantile_cont(d, 0.75) AS d3 FROM f"


@query(FEAT + f", q AS ({Q}), u AS (SELECT unnest(['a', 'b', 'd']) AS feature, unnest([a1, b1, d1]) AS q1, unnest([a3, b3, d3]) AS q3 FROM q) SELECT feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high FROM u")
def iqr_bounds(spark, sf_dir):
    f = dataset.fences(features(spark, sf_dir), COLUMNS)
    return f.select("feature", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "iqr", "low", "high")])


@query(FEAT + f", q AS ({Q}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN round(greatest({c}1 - 0.5 * ({c}3 - {c}1), least({c}3 + 0.5 * ({c}3 - {c}1), {c})), 6) END AS {c}" for c in COLUMNS) + " FROM f, q")
def iqr_clip(spark, sf_dir):
    c = dataset.clip_outliers(features(spark, sf_dir).drop("l_returnflag"), COLUMNS, 0.5)
    return c.select(*[F.round(x, 6).alias(x) if x in COLUMNS else F.col(x) for x in c.columns])


@query(FEAT + f", q AS ({Q}) SELECT unnest(['a', 'b', 'd']) AS feature, unnest([" + ", ".join(f"count(*) FILTER (WHERE {c} < {c}1 - 0.5 * ({c}3 - {c}1) OR {c} > {c}3 + 0.5 * ({c}3 - {c}1))" for c in COLUMNS) + "]) AS n_outliers FROM f, q")
def iqr_outliers(spark, sf_dir):
    return dataset.outliers(features(spark, sf_dir), COLUMNS, 0.5)


LEFT = "CASE WHEN {x} >= 0 AND {x} < 70 THEN 0 WHEN {x} >= 70 AND {x} < 100 THEN 1 WHEN {x} >= 100 AND {x} < 125 THEN 2 WHEN {x} >= 125 AND {x} < 180 THEN 3 WHEN {x} >= 180 AND {x} < 999 THEN 4 END"


@query(CUST + f" SELECT c_custkey, {LEFT.format(x='y')} AS range_id FROM cu")
def glucose_bin_left(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", scalars.range_left("y").alias("range_id"))


@query(CUST + f" SELECT c_custkey, {CLASSES.format(x='y')} AS class FROM cu")
def glucose_class_right(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", scalars.class_right("y").alias("class"))


@query(CUST + ", k AS (SELECT c_custkey, y, greatest(0, least(1, (greatest(40, least(240, y)) - 40) / 200)) AS g FROM cu) SELECT c_custkey, round(CASE WHEN y IS NOT NULL THEN g END, 6) AS gauge FROM k")
def gauge_position(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", F.round(scalars.gauge("y"), 6).alias("gauge"))


SPLIT = CUST + f", b AS (SELECT c_custkey, {LEFT.format(x='y')} AS range_id FROM cu WHERE y IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY (c_custkey * 7919) % 10007, c_custkey) AS rn FROM b)"


@query(SPLIT + " SELECT c_custkey, range_id, CASE WHEN rn <= CASE range_id WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 2 ELSE 0 END THEN 'test' ELSE 'train' END AS split FROM n")
def stratified_split(spark, sf_dir):
    c = dataset.drop_unlabelled(customers(spark, sf_dir), "y").select("c_custkey", scalars.range_left("y").alias("range_id"))
    return dataset.stratified_split(c, "range_id", {0: 3, 1: 7, 2: 4, 3: 5, 4: 2}, [F.col("c_custkey") * 7919 % 10007, F.col("c_custkey")])


@query("WITH n AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey * 7919) % 10007, c_custkey) AS rn FROM customer) SELECT c_custkey, CAST((rn - 1 + c_nationkey) % 5 AS INTEGER) AS fold FROM n")
def kfold_assign(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return dataset.folds(c, 5, [F.col("c_custkey") * 7919 % 10007, "c_custkey"], group="c_nationkey").select("c_custkey", "fold")


@query(FEAT + ", q AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.5) AS a2, quantile_cont(a, 0.75) AS a3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.5) AS b2, quantile_cont(b, 0.75) AS b3, quantile_cont(d, 0.25) AS d1, quantile_cont(d, 0.5) AS d2, quantile_cont(d, 0.75) AS d3 FROM f WHERE l_returnflag <> 'R') SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"round(CASE WHEN {c}3 = {c}1 THEN {c} - {c}2 ELSE ({c} - {c}2) / ({c}3 - {c}1) END, 6) AS {c}" for c in COLUMNS) + " FROM f, q")
def robust_scale(spark, sf_dir):
    f = features(spark, sf_dir)
    s = dataset.scale(f, dataset.scaler(f.where("l_returnflag <> 'R'"), COLUMNS), COLUMNS)
    return s.drop("l_returnflag").select(*[F.round(x, 6).alias(x) if x in COLUMNS else F.col(x) for x in s.columns if x != "l_returnflag"])


@query(FEAT + ", q AS (SELECT quantile_cont(b, 0.5) AS m, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS s FROM f) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a, round((b - m) / s, 6) AS b, CASE WHEN d IS NOT NULL THEN 0.0 END AS d FROM f, q")
def scaler_lookup_service(spark, sf_dir):
    f = features(spark, sf_dir)
    known = dataset.scaler(f, ["b"]).unionByName(spark.range(1).select(F.lit("d").alias("feature"), F.lit(1.0).alias("center"), F.lit(0.0).alias("scale")))
    s = dataset.scale(f, known, COLUMNS, "service")
    return s.withColumn("b", F.round("b", 6)).drop("l_returnflag")


@query(CUST + " SELECT count(*) AS n, sum(CASE WHEN y >= 130 THEN 2.0 ELSE 1.0 END) AS weight, round(sum(CASE WHEN y >= 130 THEN 2.0 ELSE 1.0 END * y) / sum(CASE WHEN y >= 130 THEN 2.0 ELSE 1.0 END), 6) AS weighted_mean FROM cu WHERE y IS NOT NULL")
def sample_weight(spark, sf_dir):
    c = dataset.drop_unlabelled(customers(spark, sf_dir), "y").withColumn("w", boost.sample_weight("y", Boosting()))
    return c.agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.round(F.sum(F.col("w") * F.col("y")) / F.sum("w"), 6).alias("weighted_mean"))


METRICS = "count(*) AS n, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) AS r2, 100 * avg(abs(y - yhat) / abs(y)) AS mape"
ROUNDED = "n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(mape, 6) AS mape"


def rounded(df, *keys):
    return df.select(*keys, "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2", "mape")])


@query(PRED + f", m AS (SELECT {METRICS} FROM p) SELECT {ROUNDED} FROM m")
def regression_metrics(spark, sf_dir):
    return rounded(evaluate.metrics(predictions(spark, sf_dir), "y", "yhat"))


@query(PRED + f", m AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS fold, {METRICS} FROM p GROUP BY ALL) SELECT avg_mae, std_mae FROM (SELECT round(avg(mae), 6) AS avg_mae, round(stddev_pop(mae), 6) AS std_mae FROM m)")
def fold_summary(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("fold", (F.col("o_orderkey") % 5).cast("int"))
    m = evaluate.metrics(p, "y", "yhat", ["fold"])
    return m.agg(F.round(F.avg("mae"), 6).alias("avg_mae"), F.round(F.stddev_pop("mae"), 6).alias("std_mae"))


@query(PRED + f", e AS (SELECT {LEFT.format(x='y')} AS range_id, abs(y - yhat) AS e FROM p), g AS (SELECT range_id, count(*) AS n, round(avg(e), 2) AS mean_error, round(max(e), 2) AS max_error FROM e GROUP BY ALL) SELECT CAST(t.i AS INTEGER) AS range_id, coalesce(n, 0) AS n, mean_error, max_error FROM range(0, 5) t(i) LEFT JOIN g ON g.range_id = t.i")
def per_range_error(spark, sf_dir):
    return evaluate.per_range(predictions(spark, sf_dir), "y", "yhat")


@query(PRED + ", s AS (SELECT o_custkey, avg(abs(y - yhat)) FILTER (WHERE o_orderkey % 4 = 0) / avg(abs(y - yhat)) FILTER (WHERE o_orderkey % 4 <> 0) AS r FROM p GROUP BY ALL) SELECT o_custkey, CASE WHEN r > 3 THEN 'severe' WHEN r > 2 THEN 'moderate' WHEN r > 1.5 THEN 'mild' WHEN r >= 0.8 THEN 'good' WHEN r IS NOT NULL THEN 'test_better' END AS verdict FROM s")
def overfit_verdict(spark, sf_dir):
    """Errors are added in the order of a customer's orders, so that no partitioning decides a ratio that lies on a bound."""
    p = predictions(spark, sf_dir).withColumn("e", F.abs(F.col("y") - F.col("yhat")))
    test, order = F.col("o_orderkey") % 4 == 0, Window.partitionBy("o_custkey").orderBy("o_orderkey", "e")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    mean = lambda which: F.avg(F.when(which, F.col("e"))).over(so_far)
    s = p.select("o_custkey", scalars.error_ratio(mean(test), mean(~test)).alias("r"), (F.lead(F.lit(1)).over(order).isNull()).alias("last")).where("last")
    return s.select("o_custkey", scalars.overfit_verdict("r").alias("verdict"))


@query("SELECT c_custkey, CASE WHEN t - s > 0.05 OR m > 1.15 OR q > 1.15 THEN 'overfitting' WHEN t < 0.7 AND s < 0.7 THEN 'underfitting' ELSE 'well_generalised' END AS verdict FROM (SELECT c_custkey, (c_custkey % 64) / 64.0 AS t, (c_custkey % 61) / 64.0 AS s, 1 + (c_custkey % 7) / 32.0 AS m, 1 + (c_custkey % 5) / 32.0 AS q FROM customer)")
def fit_verdict(spark, sf_dir):
    k = F.col("c_custkey")
    verdict = scalars.fit_verdict(k % 64 / 64.0, k % 61 / 64.0, 1 + k % 7 / 32.0, 1 + k % 5 / 32.0)
    return table(spark, sf_dir, "customer").select("c_custkey", verdict.alias("verdict"))


CLARKE = """CASE WHEN abs(yhat - y) <= 0.2 * y THEN 'A' WHEN y < 70 AND yhat < 70 THEN 'A' WHEN y < 70 AND yhat > 180 THEN 'E' WHEN y > 180 AND yhat < 70 THEN 'E'
WHEN y < 70 AND yhat >= 70 AND yhat <= 180 THEN 'D' WHEN y > 240 AND yhat >= 70 AND yhat <= 180 THEN 'D'
WHEN y >= 70 AND y <= 180 AND yhat > 180 AND yhat > 1.2 * y THEN 'C' WHEN y >= 70 AND y <= 180 AND yhat < 70 AND yhat < 0.8 * y THEN 'C' ELSE 'B' END"""


@query(PRED + f" SELECT o_orderkey, {CLARKE} AS zone FROM p")
def clarke_zone(spark, sf_dir):
    return predictions(spark, sf_dir).select("o_orderkey", scalars.clarke_zone("y", "yhat").alias("zone"))


@query(PRED + ", k AS (SELECT count(*) AS n, count(*) FILTER (WHERE abs(yhat - y) <= 0.2 * y) AS n_zone_a FROM p) SELECT n, n_zone_a, round(100.0 * n_zone_a / n, 6) AS zone_a_pct FROM k")
def clarke_zone_a_pct(spark, sf_dir):
    z = evaluate.zone_a(predictions(spark, sf_dir), "y", "yhat")
    return z.select("n", "n_zone_a", F.round("zone_a_pct", 6).alias("zone_a_pct"))


@query(PRED + " SELECT o_orderkey, round(yhat - y, 6) AS error, round(100 * (yhat - y) / y, 6) AS percent_error, round(abs(yhat - y), 6) AS abs_error FROM p")
def prediction_table(spark, sf_dir):
    e = F.col("yhat") - F.col("y")
    return predictions(spark, sf_dir).select("o_orderkey", F.round(e, 6).alias("error"), F.round(scalars.safe_ratio(100 * e, F.col("y")), 6).alias("percent_error"), F.round(F.abs(e), 6).alias("abs_error"))


IMP = "WITH i AS (SELECT p_brand AS feature, CAST(sum(p_size) AS DOUBLE) AS importance FROM part GROUP BY ALL)"


def importance(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").cast("double").alias("importance"))


@query(IMP + ", r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank, round(100 * importance / sum(importance) OVER (), 2) AS percentage FROM i) SELECT *, round(sum(percentage) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM r")
def importance_rank_cum(spark, sf_dir):
    return evaluate.importance_table(importance(spark, sf_dir))


@query(IMP + " SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) - 1 AS INTEGER) AS place, * FROM i ORDER BY importance DESC, feature LIMIT 10")
def top_n(spark, sf_dir):
    return evaluate.selected(importance(spark, sf_dir), top=10)


@query(IMP + " SELECT feature FROM (VALUES ('Brand#1'), ('none'), ('Brand#0')) t(feature) WHERE feature NOT IN (SELECT feature FROM i WHERE importance > 0)")
def unused_features(spark, sf_dir):
    return evaluate.unused(importance(spark, sf_dir), ["Brand#1", "none", "Brand#0"])


@query(FEAT + " SELECT feature, l_orderkey * 8 + l_linenumber AS row FROM (SELECT unnest(['a', 'b', 'd']) AS feature, unnest([a, b, d]) AS v, l_orderkey, l_linenumber FROM f) WHERE v IS NULL")
def null_rows(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("row", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return dataset.null_rows(f, COLUMNS, "row")


@query("WITH n AS (SELECT n_name, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE 1.0 END AS v, n_nationkey FROM nation)" + KEYED + " SELECT n_name AS name, CASE WHEN lower(trim(n_name)) NOT IN (SELECT k FROM r) THEN 'no_metadata_match' ELSE 'no_feature_values' END AS reason FROM n WHERE lower(trim(n_name)) NOT IN (SELECT k FROM r) OR v IS NULL")
def join_failures(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 4 != 1, 1.0).alias("v"))
    return dataset.failures(n, label_rows(spark, sf_dir), "n_name", "label_key", ["v"])


@query("SELECT c_custkey, round(0.4 * greatest(0, t - s) + 0.3 * greatest(0, m - 1) + 0.3 * greatest(0, m - 1), 6) AS overfitting, round(0.5 * greatest(0, 0.7 - t) + 0.5 * greatest(0, 0.7 - s), 6) AS underfitting FROM (SELECT c_custkey, (c_custkey % 100) / 100.0 AS t, (c_custkey % 83) / 100.0 AS s, 0.5 + (c_custkey % 31) / 20.0 AS m FROM customer)")
def fit_scores(spark, sf_dir):
    k = F.col("c_custkey")
    over, under = scalars.fit_scores(k % 100 / 100.0, k % 83 / 100.0, 0.5 + k % 31 / 20.0, 0.5 + k % 31 / 20.0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(over, 6).alias("overfitting"), F.round(under, 6).alias("underfitting"))


@query(CUST + f""", k AS (SELECT {LEFT.format(x='y')} AS r, count(*) AS n FROM cu GROUP BY ALL), m AS (SELECT count(*) AS n FROM customer)
SELECT unnest([1, 2, 3, 3, 4, 5, 5, 5, 6]) AS step, unnest([
  'train 5 and test 12 rows of ' || (SELECT n FROM m), '5 names for 6 strata', 'no quota for 2', 'quota for unknown 9', 'quotas sum to 1000001, not 12',
  'forced row 0 of ' || (SELECT n FROM m), 'forced row 999999999 of ' || (SELECT n FROM m), 'forced rows repeat', 'stratum 0: 1000000 of ' || (SELECT n FROM k WHERE r = 0) || ' rows']) AS problem""")
def split_checks(spark, sf_dir):
    """Every check of a split's settings but the one of too many forced rows fails here."""
    c = customers(spark, sf_dir).select(scalars.range_left("y").alias("range_id"))
    plan = dataset.SplitPlan(n_train=5, n_test=12, edges=(40.0, 100.0, 125.0, 180.0, 240.0, 300.0, 400.0), names=(0, 1, 2, 3, 4), quotas={0: 1_000_000, 1: 1, 3: 0, 4: 0, 9: 7}, forced=(3, 0, 3, 999_999_999))
    return dataset.check_split(c, "range_id", plan)


@query(IMP + " SELECT feature, importance FROM (SELECT *, importance / sum(importance) OVER () AS s FROM i) WHERE s >= 0.04")
def min_fraction(spark, sf_dir):
    return evaluate.at_least(importance(spark, sf_dir), 0.04)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def union_align(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return dataset.align(a, b)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def complement(spark, sf_dir):
    part = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return dataset.complement(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), part, "c_custkey")


@query("SELECT c.c_custkey, c_name, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal, u.checked FROM customer c LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal, count(*) AS checked FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) u ON u.c_custkey = c.c_custkey")
def keyed_update(spark, sf_dir):
    u = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.count("*").alias("checked"))
    return dataset.update_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), u, "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    t = {"predictions": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")}
    return store.delete_subject(t, gone, "o_custkey")["predictions"]


@query("SELECT s_suppkey, CAST(regexp_extract(f, '(?i)_win(\\d+)', 1) AS INTEGER) AS win, 'subject_' || s_suppkey AS subject, regexp_replace(f, '[^A-Za-z0-9]', '_', 'g') AS safe FROM (SELECT s_suppkey, 'subject_' || s_suppkey || '_Win' || (s_suppkey % 7) || '_Filtered' AS f FROM supplier)")
def parse_names(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    f = F.concat(F.lit("subject_"), k, F.lit("_Win"), (F.col("s_suppkey") % 7).cast("string"), F.lit("_Filtered"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", f.alias("f"))
    return s.select("s_suppkey", scalars.window_number("f").alias("win"), scalars.subject_name("f").alias("subject"), scalars.safe_name("f").alias("safe"))


NODES = [
    (0, 0, "a", 20.0, 1, 2, None, 5.0, 100.0), (0, 1, "b", 30000.0, 3, 4, None, 3.0, 60.0), (0, 2, None, None, None, None, 1.5, None, 40.0), (0, 3, None, None, None, None, -2.0, None, 30.0), (0, 4, None, None, None, None, 0.25, None, 30.0),
    (1, 0, "d", 4.5, 1, 2, None, 2.0, 100.0), (1, 1, None, None, None, None, -0.5, None, 55.0), (1, 2, None, None, None, None, 0.75, None, 45.0),
]


def nodes(spark):
    from pulsegrid.schema import NODES as SCHEMA

    return spark.createDataFrame(NODES, SCHEMA)


@query(FEAT + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 10 + CASE WHEN coalesce(a, -1) < 20 THEN CASE WHEN b < 30000 THEN -2.0 ELSE 0.25 END ELSE 1.5 END + CASE WHEN d < 4.5 THEN -0.5 ELSE 0.75 END AS score FROM f")
def tree_score_case(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", boost.score_expression(NODES, 10.0).alias("score"))


@query("SELECT * FROM (VALUES (0, 5::BIGINT, 3::BIGINT, 2, round((1.5 - 2.0 + 0.25) / 3, 6)), (1, 3, 2, 1, 0.125)) t(tree, n_nodes, n_leaves, depth, mean_leaf)")
def tree_topology(spark, sf_dir):
    return evaluate.topology(nodes(spark)).withColumn("mean_leaf", F.round("mean_leaf", 6))


@query("SELECT * FROM (VALUES ('a', 1::BIGINT, 5.0::DOUBLE, 5.0::DOUBLE, 100.0::DOUBLE), ('b', 1, 3.0, 3.0, 60.0), ('d', 1, 2.0, 2.0, 100.0)) t(feature, weight, total_gain, importance, cover)")
def tree_importance(spark, sf_dir):
    return evaluate.node_importance(nodes(spark))


@query("SELECT c_mktsegment, count(DISTINCT coalesce(c_nationkey, -1)) > 1 AS mixed, count(DISTINCT coalesce(c_nationkey, -1)) AS n_settings, count(*) AS n FROM customer GROUP BY ALL")
def config_consistency(spark, sf_dir):
    return dataset.consistency(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_nationkey"])


@query("SELECT l_suppkey, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, median(l_quantity) AS med FROM lineitem GROUP BY ALL")
def summary_statistics(spark, sf_dir):
    s = dataset.summary(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_suppkey"])
    return s.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query(FEAT + ", q AS (SELECT quantile_cont(b, 0.5) AS m, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS s FROM f) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a, round((b - m) / s, 6) AS b, d FROM f, q")
def scaler_lookup_inference(spark, sf_dir):
    """Inference keeps values without a scaler, or with a scale of 0."""
    f = features(spark, sf_dir)
    known = dataset.scaler(f, ["b"]).unionByName(spark.range(1).select(F.lit("d").alias("feature"), F.lit(1.0).alias("center"), F.lit(0.0).alias("scale")))
    return dataset.scale(f, known, COLUMNS, "inference").withColumn("b", F.round("b", 6)).drop("l_returnflag")


@query()
def boosted_trees(spark, sf_dir):
    """75 trees fitted on the line items' features, and the errors of their predictions by supplier."""
    f = dataset.impute(features(spark, sf_dir), COLUMNS).withColumn("y", 60 + 2 * F.col("a") - F.col("d") * 3)
    model = boost.fit(f, COLUMNS, "y", Boosting())
    scored = f.withColumn("yhat", boost.score_expression(model.nodes, model.base))
    return evaluate.metrics(scored, "y", "yhat", ["l_suppkey"])



@query(IMP + " SELECT 0 AS place, 'Brand#3' AS feature, coalesce((SELECT importance FROM i WHERE feature = 'Brand#3'), 0) AS importance UNION ALL SELECT 2, 'none', 0 UNION ALL SELECT 3, 'Brand#1', coalesce((SELECT importance FROM i WHERE feature = 'Brand#1'), 0)")
def feature_mask(spark, sf_dir):
    return evaluate.selected(importance(spark, sf_dir), {"Brand#3": 1, "Brand#2": 0, "none": 1, "Brand#1": 1})


@query(PRED + f" SELECT o_orderkey, round(yhat - y, 6) AS error, round(abs(yhat - y), 6) AS abs_error, round(100 * abs(yhat - y) / abs(y), 6) AS percent_error, {CLARKE} AS zone FROM p")
def single_point_validation(spark, sf_dir):
    p = evaluate.single_point(predictions(spark, sf_dir), "y", "yhat")
    return p.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("error", "abs_error", "percent_error")], "zone")


@query("SELECT o_custkey AS subject_id, count(*) AS n_windows, CAST(min(o_orderkey) AS BIGINT) AS first FROM orders GROUP BY ALL")
def subject_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("win"), "o_totalprice")
    return store.report(o).select("subject_id", "n_windows", F.get_json_object("document", "$.windows[0].win").cast("long").alias("first"))
