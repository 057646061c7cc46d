import pytest
from oracle import connect, differences

from pulsegrid.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_stream_reads_a_table_of_part_files(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one, many = ({(r.subject_id, r.win, r.i, r.ir) for r in QUERIES["stream_windows"](spark, d).collect()} for d in (sf_dir, str(tmp_path)))
    assert one and many == one


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
