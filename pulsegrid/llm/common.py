"""What the operators share: tables, shared storage, distributed running totals and component search."""

from __future__ import annotations

import atexit
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.shared import fresh_path

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges per key of ``running_total``, and coarse ranges of them: no window of totals has more than 128 rows.
RANGE_BITS, COARSE_BITS = 14, 7
#: A side of a join is broadcast only up to so many rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: cuts the lineage, survives lost executors, has known sizes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a materialized table that nothing reads any more."""
    path = df._written_at
    if path in _written:
        _written.remove(path)
        _delete(path)


def written() -> frozenset[str]:
    """The materialized tables there are."""
    return frozenset(_written)


def release(before: frozenset[str], *kept: DataFrame) -> None:
    """Deletes the tables materialized since ``before``, except ``kept``, which are such tables."""
    for path in [p for p in _written if p not in before and p not in {df._written_at for df in kept}]:
        _written.remove(path)
        _delete(path)


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path in _written:
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder belongs to the cluster
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else as it is (then Spark shuffles both sides)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def null_safe(column: Column | str) -> Column:
    """A non-null string key that keeps null apart from every string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def running_total(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come earlier.

    order: a uniformly distributed long (a hash). The queue of a key is cut into 2^14 ranges of it, so that
    no task holds a whole key: totals per range are summed over the ranges in two levels of 128, and only
    the rows of one range meet in a window. Keys must not be null. Repeated rows take turns.
    """
    bucketed = df.withColumn("_rt_value", value).withColumn("_rt_range", F.shiftright(F.col(order), 64 - RANGE_BITS).cast("int"))
    totals = bucketed.groupBy(*keys, "_rt_range").agg(F.sum("_rt_value").alias("_rt_sum"))
    totals = totals.withColumn("_rt_coarse", F.shiftright("_rt_range", RANGE_BITS - COARSE_BITS))
    earlier = lambda *by: Window.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = totals.groupBy(*keys, "_rt_coarse").agg(F.sum("_rt_sum").alias("_rt_sum"))
    coarse = coarse.select(*keys, "_rt_coarse", F.coalesce(F.sum("_rt_sum").over(earlier("_rt_coarse")), F.lit(0)).alias("_rt_before"))
    fine = totals.withColumn("_rt_start", F.coalesce(F.sum("_rt_sum").over(earlier("_rt_coarse", "_rt_range")), F.lit(0)))
    starts = fine.join(coarse, [*keys, "_rt_coarse"]).select(*keys, "_rt_range", (F.col("_rt_start") + F.col("_rt_before")).alias("_rt_start"))
    inside = Window.partitionBy(*keys, "_rt_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = bucketed.hint("merge").join(starts, [*keys, "_rt_range"])
    total = F.col("_rt_start") + F.coalesce(F.sum("_rt_value").over(inside), F.lit(0))
    return joined.withColumn(out, total).drop("_rt_value", "_rt_range", "_rt_start")


#: A node with more neighbours is a hub; at scale the limit is the number of links over ``BROADCAST_ROWS``, so hubs always fit a broadcast.
HUB = 512


def _with_least(rows: DataFrame, links: DataFrame, n_links: int) -> DataFrame:
    """rows (a, b) with m, the smallest b of ``links`` for each a.

    Few links: all minimums are broadcast. Else the rows of hubs, if there are any, stay where they are and only the hubs'
    minimums are broadcast: at most 2 n_links / limit nodes have more than limit of at most 2 n_links ends. All others have
    so few rows that a task can hold a node's.
    """
    limit = max(HUB, -(-2 * n_links // BROADCAST_ROWS))
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    if 2 * n_links <= BROADCAST_ROWS:
        return rows.join(F.broadcast(least.select("a", "m")), "a").select("a", "b", "m")
    hubs = least.where(F.col("_n") > limit).select("a", F.col("m").alias("_hub"))
    if not hubs.limit(1).count():
        return rows.join(least.select("a", "m"), "a").select("a", "b", "m")
    marked = rows.join(F.broadcast(hubs), "a", "left")
    near = marked.where("_hub IS NOT NULL").select("a", "b", F.col("_hub").alias("m"))
    far = marked.where("_hub IS NULL").select("a", "b").join(least.where(F.col("_n") <= limit).select("a", "m"), "a")
    return near.unionByName(far)


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): (node, comp), comp being the smallest node.

    Alternates two star contractions until nothing changes; every round is written to the shared folder, hubs are
    reduced by map-side minimums, and no list of links is ever gathered.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, name)
    state = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = state(e)
    for _ in range(rounds):
        if not last[0]:
            break
        # large star: each neighbour greater than the node is linked to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both.where("b > a"), both, last[0]).select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = materialize(large, name)
        # small star: smaller neighbours and the node itself are linked to the smallest
        links = _with_least(large, large, last[0])
        new = links.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(links.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(new, name)
        now = state(new)
        forget(large)
        forget(e)
        e = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("component search did not settle")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))


#: Rows a Python worker handles at once.
BATCH_ROWS = 512


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow in slices of few rows; Spark itself bounds the bytes of a batch."""

    def run(batches):
        return function(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)
