"""Flushes by rows, by time and at the stop; windows of a backlog."""

import time

from pyspark.sql import functions as F

from pulsegrid.streaming import stream

SCHEMA = "subject_id long, seq long, ir double, red double"


def samples(spark, ids):
    return spark.createDataFrame([(i % 3, i, float(i), 1.0) for i in ids], SCHEMA)


def test_flush_by_rows_then_by_time(spark, tmp_path):
    """Twenty samples leave at once; the rest waits a second after its first sample and leaves whole."""
    samples(spark, range(100)).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    sink = lambda batch, epoch: seen.extend((epoch, *r) for r in batch.groupBy("subject_id", "flush", "cause").agg(F.count("*"), F.min("seq"), F.max("seq")).collect())
    with stream.rocksdb(spark):
        raw = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = stream.write(stream.flushed(raw, 20, 1.0), sink, str(tmp_path / "state"), "flushes", "1 second").start()
    deadline = time.time() + 90
    while time.time() < deadline and sum(r[4] for r in seen) < 100:
        time.sleep(0.5)
    q.stop()
    assert sorted(r[1:] for r in seen) == [
        (0, 0, "rows", 20, 0, 57), (0, 1, "time", 14, 60, 99), (1, 0, "rows", 20, 1, 58), (1, 1, "time", 13, 61, 97), (2, 0, "rows", 20, 2, 59), (2, 1, "time", 13, 62, 98),
    ]
    assert {r[0] for r in seen if r[3] == "rows"} == {0} and min(r[0] for r in seen if r[3] == "time") > 0


def test_batches_fill_a_flush_and_the_rest_is_left(spark, tmp_path):
    for i in range(4):  # a file a batch: seven or so samples of each subject
        samples(spark, range(20 * i, 20 * i + 20)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    with stream.rocksdb(spark, draining=True):
        raw = spark.readStream.schema(f"{SCHEMA}, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.write(stream.flushed(raw, 10), str(tmp_path / "out"), str(tmp_path / "state"), "drain", None).start().awaitTermination()
    given = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.subject_id, r.flush): r["count"] for r in given.groupBy("subject_id", "flush").count().collect()} == {(s, f): 10 for s in range(3) for f in range(2)}
    rest = stream.leftovers(spark, str(tmp_path / "state"))
    assert {(r.subject_id, r.flush): r["count"] for r in rest.groupBy("subject_id", "flush").count().collect()} == {(0, 2): 7, (1, 2): 7, (2, 2): 6}
    both = [r.seq for r in given.select("seq").union(rest.select("seq")).collect()]
    assert sorted(both) == list(range(80))


def test_backlog_of_one_subject(spark, tmp_path):
    """A backlog of many windows is cut in one pass, and the rest of one batch opens the next window."""
    spark.range(200_000).select(F.lit(7).cast("long").alias("subject_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("ir"), F.lit(None).cast("double").alias("red")).coalesce(1).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    stream.write(stream.count_windows(raw, 16, stop_after=199_000), str(tmp_path / "out"), str(tmp_path / "state"), "backlog", None).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 199_000 // 16
    assert rows.where("ir[0] <> win * 16 OR ir[15] <> win * 16 + 15 OR n <> 16 OR red[3] IS NOT NULL AND NOT isnan(red[3])").count() == 0
