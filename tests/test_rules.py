"""Rows on the bounds of rules, in tables of their own, against the queries' SQL."""

import json
from pathlib import Path

import duckdb
import pytest
from oracle import differences

from pulsegrid.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture
def check(spark, tmp_path):
    """Rows of a table (its columns as DDL) through a query and its SQL; both ways to differ."""

    def run(name, table, ddl, rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        return differences(QUERIES[name](spark, str(tmp_path)), con, SQL[name])

    return run


def events(user, values):
    return [(i, user, None, v, json.dumps({"k": 1})) for i, v in enumerate(values)]


def shared(spark):
    return Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "pulsegrid"


EVENTS = "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz"


def timed(rows):
    from datetime import datetime, timedelta

    return [(*r, datetime(2024, 1, 1) + timedelta(seconds=r[0])) for r in rows]


@pytest.mark.parametrize("name", ["beat_duration_median_filter", "ensemble_mean_std"])
def test_a_plateau_is_no_valley(check, name):
    assert check(name, "events", EVENTS, timed(events(7, map(float, [5, 1, 6, 2, 2, 7, 3, 8, 4, 9, 1, 6, 2, 7, 3, 8])))) == ([], [])


def test_files_of_recordings_go_by_the_rows(check, spark):
    """300 subjects, some of negative number, are few files; the SQL has them all."""
    before = {*shared(spark).glob("recordings-*")}
    assert check("csv_recordings", "events", EVENTS, timed([r for u in range(-150, 150) for r in events(u, [1.5, 2.5])])) == ([], [])
    (at,) = {*shared(spark).glob("recordings-*")} - before
    assert len([*at.rglob("*.csv")]) < 30


ORDERS = "o_orderkey long, o_custkey long"


@pytest.mark.parametrize("name", ["clarke_zone", "single_point_validation"])
def test_a_prediction_a_fifth_off_but_for_rounding_is_in_no_zone_c(check, name):
    assert check(name, "orders", ORDERS, [(282855, 1), (282856, 1)]) == ([], [])


def test_values_above_the_scale_are_near_its_top(check):
    assert check("decibels", "events", EVENTS, timed(events(1, [100.0, 300.0, 490.0, 490.01, 491.0, 492.5, 520.0, None]))) == ([], [])


def test_a_ratio_on_a_bound_does_not_depend_on_the_order_of_rows(check, spark, tmp_path):
    keys = [758371, 782689, 783064, 797172, 802087, 811261, 860798, 872691, 877490, 893322, 897719, 899552]
    assert check("overfit_verdict", "orders", ORDERS, [(k, 1) for k in keys]) == ([], [])
    mixed = [897719, 877490, 758371, 783064, 872691, 860798, 797172, 802087, 899552, 782689, 893322, 811261]
    spark.createDataFrame([(k, 1) for k in mixed], ORDERS).coalesce(1).write.parquet(f"{tmp_path}/mixed/orders.parquet")
    assert [r.verdict for r in QUERIES["overfit_verdict"](spark, f"{tmp_path}/mixed").collect()] == ["test_better"]


def test_a_training_error_of_zero_is_severe(check):
    """Order 1167 (training) and 2368 (test) have no error: one side without, both, each alone."""
    rows = [(1167, 1), (4, 1), (1167, 2), (2368, 2), (1167, 3), (2368, 4), (5, 5), (2368, 5)]
    assert check("overfit_verdict", "orders", ORDERS, rows) == ([], [])


@pytest.mark.parametrize("name", ["single_point_validation", "prediction_table"])
def test_percentages_are_rounded_as_their_sql_has_them(check, name):
    assert check(name, "orders", ORDERS, [(k, 1) for k in (51376, 87376, 100928, 184576)]) == ([], [])
