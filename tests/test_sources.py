"""Sources of files whose headers, names and nesting differ."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import readings


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a one.csv").write_text(" IR , RED \n1,2\n\n3,4\n")
    (tmp_path / "b+2.csv").write_text('Red_Value,note,"IR_Value"\n20,"x, y",10\nbad,z,11\n21,,12\n')
    (tmp_path / "c%3_win7.csv").write_text("﻿Timestamp,infrared,red_value\n0.5,5,6\n1.0,7,8\n")
    (tmp_path / "d.csv").write_text("ir,infrared,IR_Value,red\n1,2,3,4\n9\n")
    rows = readings.read_recordings(spark, str(tmp_path)).collect()
    got = sorted((r.subject, r.win, r.seq, r.ts, r.ir, r.red) for r in rows)
    assert got == [
        ("a one", 999, 1, 0.0, 1.0, 2.0), ("a one", 999, 2, 0.0025, 3.0, 4.0), ("b+2", 999, 1, 0.0, 10.0, 20.0), ("b+2", 999, 3, 0.005, 12.0, 21.0),
        ("c%3", 7, 1, 0.0, 5.0, 6.0), ("c%3", 7, 2, 0.5, 7.0, 8.0), ("d", 999, 1, 0.0, 3.0, 4.0),
    ]
    assert {r.recording for r in rows} == {f"file:{tmp_path}/{n}.csv" for n in ("a one", "b+2", "c%3_win7", "d")}


def test_blocks_of_a_file_keep_their_order(spark, tmp_path):
    """A file of many blocks and one of another header beside it."""
    (tmp_path / "long.csv").write_text("red,ir\n" + "".join(f"{i},{i}.5\n" for i in range(20_000)))
    (tmp_path / "other.csv").write_text("ir,red\n7,8\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = readings.read_recordings(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = sorted((r.seq, r.red, r.ir) for r in rows if r.subject == "long")
    assert long == [(i + 1, float(i), i + 0.5) for i in range(20_000)]
    assert [(r.seq, r.ir, r.red) for r in rows if r.subject == "other"] == [(1, 7.0, 8.0)]


def test_a_file_without_a_channel_is_named(spark, tmp_path):
    (tmp_path / "good.csv").write_text("ir,red\n1,2\n")
    (tmp_path / "lame.csv").write_text("ir,blue\n1,2\n")
    with pytest.raises(ValueError, match="lame.csv"):
        readings.read_recordings(spark, str(tmp_path))


def test_a_folder_of_files_is_a_recording(spark, tmp_path):
    for name, text in (("x/one.csv", "ir,red\n1,2\n3,4\n"), ("x/two.csv", "Red_Value,IR_Value\n6,5\n"), ("y/one.csv", "ir,red\n7,8\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = readings.read_recordings(spark, str(tmp_path / "*"), by="folder").collect()
    assert sorted((r.subject, r.seq, r.ir, r.red) for r in rows) == [("x", 1, 1.0, 2.0), ("x", 2, 3.0, 4.0), ("x", 3, 5.0, 6.0), ("y", 1, 7.0, 8.0)]


def test_rows_name_their_recordings(spark, tmp_path):
    """Recordings that alternate and go on in another file, of other columns; rows without a name; a header repeated inside."""
    (tmp_path / "a.csv").write_text(" Subject ,IR,Red\nu,1,2\nv/w_Win7,3,4\nu,bad,6\n Subject ,IR,Red\n\n,7,8\nu , 9,10\n")
    (tmp_path / "b.csv").write_text('red,note,infrared,RECORDING\n12,"x, y",11,"v/w_Win7"\n17\n')
    (tmp_path / "d.csv").write_text("time,red,ir_raw,subject name\n6,14,13,t\n6.5,16,15,t\n")
    rows = readings.read_recordings(spark, str(tmp_path), by="column").collect()
    assert sorted((r.recording, r.subject, r.win, r.seq, r.ts, r.ir, r.red) for r in rows) == [
        ("t", "t", 999, 1, 0.0, 13.0, 14.0), ("t", "t", 999, 2, 0.5, 15.0, 16.0), ("u", "u", 999, 1, 0.0, 1.0, 2.0), ("u", "u", 999, 3, 0.005, 9.0, 10.0),
        ("v/w_Win7", "v/w", 7, 1, 0.0, 3.0, 4.0), ("v/w_Win7", "v/w", 7, 2, 0.0025, 11.0, 12.0),
    ]
    (tmp_path / "c.csv").write_text("ir,red\n1,2\n")
    with pytest.raises(ValueError, match="no name column in .*c.csv"):
        readings.read_recordings(spark, str(tmp_path), by="column")


def test_recordings_of_a_long_file_keep_their_order(spark, tmp_path):
    """Three recordings take turns through a file of many blocks."""
    (tmp_path / "long.csv").write_text("subject,red,ir\n" + "".join(f"s{i % 3},{i},{i}.5\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = readings.read_recordings(spark, str(tmp_path), by="column").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.red, r.subject, r.seq, r.ir) for r in rows) == [(float(i), f"s{i % 3}", i // 3 + 1, i + 0.5) for i in range(20_000)]


DOCUMENTS = [
    (1, r'{"a":{"b":[{"status":"ok \"q\"","list":[1,2]}]},"note":"\"status\": \"no\""}'),
    (2, 'not json "status": "oops"'),
    (3, '{"Metadata":{"Status":"S","feature_scaler_parameters":[{"feature":"x","center_median":1.5,"scale_iqr":2},{"feature":"y","center_median":1,"scale_iqr":0}]}}'),
    (4, None),
    (5, "[]"),
    (6, '{"x":{"status":null},"y":{"z":{"status":"deep"}}}'),
    (7, '{"a":' * 40 + '{"status":"far"}' + "}" * 40),
]


def test_keys_at_any_depth(spark):
    docs = spark.createDataFrame(DOCUMENTS, "id long, value string")
    hits = readings.find_keys(docs, "value", ["status"]).select("id", "depth", "path", F.to_json("hit").alias("hit")).collect()
    got = sorted((r.id, r.depth, r.path, r.hit) for r in hits)
    assert got == [(1, 3, "$.a.b[0].status", r'"ok \"q\""'), (3, 1, "$.Metadata.Status", '"S"'), (6, 1, "$.x.status", "null"), (6, 2, "$.y.z.status", '"deep"'), (7, 40, "$" + ".a" * 40 + ".status", '"far"')]
    status = {r.id: r.status for r in readings.parse_documents(docs).collect()}
    assert status == {1: 'ok "q"', 2: "UNKNOWN", 3: "S", 4: "UNKNOWN", 5: "UNKNOWN", 6: "UNKNOWN", 7: "far"}
    scaler = readings.scaler_parameters(docs, "id", "value").collect()
    assert [(r.id, r.feature, r.center, r.scale) for r in scaler] == [(3, "x", 1.5, 2.0)]
    assert readings.find_keys(docs.limit(0), "value", ["status"]).count() == 0
