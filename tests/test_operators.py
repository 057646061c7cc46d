import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.config import Boosting, Sampling, Settings
from pulsegrid.functions import arrays, scalars
from pulsegrid.operators import boost, dataset, evaluate, features, store, windows
from pulsegrid.plans import pipeline
from pulsegrid.sources import readings
from pulsegrid.streaming import stream


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_fences_of_the_worked_example(spark):
    q1, q3 = -0.045, 0.082
    rows = [(q1,), (q1,), (q3,), (q3,), (0.0,)]
    f = dataset.fences(frame(spark, rows, "x double"), ["x"]).first()
    assert (round(f.low, 4), round(f.high, 4)) == (-0.2355, 0.2725)


def test_drop_impute_clip(spark):
    df = frame(spark, [(1.0, 5.0), (None, 6.0), (3.0, None), (100.0, 7.0), (2.0, 8.0), (2.5, 9.0)], "x double, y double")
    out = pipeline.prepare(df, ["x"], "y")
    assert out.count() == 5 and out.where("x IS NULL").count() == 0 and out.agg(F.max("x")).first()[0] < 100


def test_split_quotas_and_checks(spark):
    rows = [(i, 1 if i < 44 else 2 if i < 69 else 3) for i in range(75)]
    df = frame(spark, rows, "id long, b int")
    quotas = {1: 7, 2: 4, 3: 1}
    s = dataset.stratified_split(df, "b", quotas, ["id"], forced=F.col("id") == 40)
    got = {(r.b, r.split): r["count"] for r in s.groupBy("b", "split").count().collect()}
    assert got == {(1, "train"): 37, (1, "test"): 7, (2, "train"): 21, (2, "test"): 4, (3, "train"): 5, (3, "test"): 1}
    assert s.where("id = 40").first().split == "test"
    plan = dataset.SplitPlan(63, 12, (0, 1, 2, 3), (1, 2, 3), quotas, (41,))
    assert dataset.check_split(df, "b", plan).count() == 0
    wrong = dataset.SplitPlan(60, 2, (0, 1, 2, 3), (1, 2), {1: 50, 3: -1}, (1, 1, 76))
    assert sorted(r.step for r in dataset.check_split(df, "b", wrong).collect()) == [1, 2, 3, 3, 4, 5, 5, 5, 6]


def test_split_sorts_no_stratum(spark):
    """Ties and equal rows never take more than the quota, and tasks drop rows before they are moved."""
    df = spark.range(5000).select((F.col("id") % 7).alias("x"), F.when(F.col("id") % 10 > 0, F.lit(0)).alias("b"))
    s = dataset.stratified_split(df, "b", {0: 9, 5: 2}, ["x"])
    assert {(r.b, r.split, r.x): r["count"] for r in s.where("split = 'test'").groupBy("b", "split", "x").count().collect()} == {(0, "test", 0): 9}
    assert s.count() == 5000 and "WindowGroupLimit" in s._jdf.queryExecution().executedPlan().toString()
    assert dataset.stratified_split(df, "b", {}, ["x"]).where("split = 'train'").count() == 5000


CLARKE = [
    (100, 120, "A"), (100, 80, "A"), (60, 69, "A"), (100, 121, "B"), (100, 190, "C"), (150, 60, "C"), (100, 65, "C"), (170, 230, "C"), (170, 204, "A"), (180, 217, "C"), (181, 230, "B"),
    (69, 181, "E"), (69, 180, "D"), (181, 69, "E"), (181, 70, "B"), (241, 180, "D"), (240, 180, "B"), (250, 70, "D"), (70, 70, "A"), (70, 180, "B"), (70, 181, "C"), (None, 5, None), (5, None, None),
]


def test_clarke_zones(spark):
    rows = [(None if r is None else float(r), None if p is None else float(p), z) for r, p, z in CLARKE]
    df = spark.createDataFrame(rows, "r double, p double, zone string")
    assert [x for x in df.select("r", "p", "zone", scalars.clarke_zone("r", "p").alias("got")).collect() if x.got != x.zone] == []


def test_verdicts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    ratios = {3.1: "severe", 3.0: "moderate", 2.1: "moderate", 2.0: "mild", 1.6: "mild", 1.5: "good", 0.8: "good", 0.79: "test_better", None: None}
    for r, v in ratios.items():
        assert one(scalars.overfit_verdict(F.lit(r).cast("double"))) == v
    fits = {(0.6, 0.5, 1.0, 1.0): "overfitting", (0.6, 0.58, 1.0, 1.0): "underfitting", (0.6, 0.75, 1.0, 1.0): "well_generalised", (0.9, 0.9, 1.2, 1.0): "overfitting", (0.9, 0.9, 1.0, 1.2): "overfitting", (0.9, 0.86, 1.15, 1.15): "well_generalised"}
    for args, v in fits.items():
        assert one(scalars.fit_verdict(*map(F.lit, args))) == v


@pytest.mark.parametrize("kind", ["infinite", "wide", "denormal", "geometric", "plain"])
def test_percentiles_of_any_doubles(spark, kind):
    """30 000 rows: more than are sorted at once, so every case goes through the buckets."""
    rng = np.random.default_rng(5)
    n = 30_000
    x = {
        "infinite": np.where(rng.random(n) < 0.2, np.inf, np.where(rng.random(n) < 0.2, -np.inf, rng.normal(size=n))),
        "wide": np.where(rng.random(n) < 0.1, rng.choice([-1.7e308, 1.7e308], n), rng.normal(size=n)),
        "denormal": rng.integers(0, 1 << 20, n) * 5e-324,
        "geometric": 2.0 ** rng.uniform(-1000, 1000, n) * rng.choice([-1.0, 1.0], n),
        "plain": rng.normal(size=n),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": rng.normal(size=n)}))
    points = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = dataset.percentiles(df, ["x", "y"], points)["x"]
    x = np.sort(x)
    for p, g in zip(points, got, strict=True):
        at = p * (n - 1)
        lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
        assert g == lo if lo == hi else lo <= g <= hi


def test_folds_cover_all_rows(spark):
    f = dataset.folds(spark.range(500), 5, ["id"])
    n = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(n) == 5 and sum(n) == 500 and min(n) > 50


def test_zero_scale_by_dialect(spark):
    df = frame(spark, [(5.0,), (7.0,)], "x double")
    p = frame(spark, [("x", 4.0, 0.0)], "feature string, center double, scale double")
    first = lambda d: [r.x for r in dataset.scale(df, p, ["x"], d).collect()]
    assert first("offline") == [1.0, 3.0] and first("inference") == [5.0, 7.0] and first("service") == [0.0, 0.0]


def test_edges_of_ranges_and_classes(spark):
    df = frame(spark, [(100.0,), (125.0,), (180.0,), (999.0,), (None,)], "x double")
    got = df.select(scalars.range_left("x"), scalars.class_right("x")).collect()
    assert [r[0] for r in got] == [2, 3, 4, None, None]
    assert [r[1] for r in got] == ["Normal", "Pre-diabetic", "Diabetic", "Hyperglycemic", None]


def test_arrays(spark):
    df = frame(spark, [([1.0, 2.0, 4.0],)], "x array<double>")
    r = df.select(arrays.trapezoid("x").alias("t"), arrays.pad("x", 5).alias("p"), arrays.shift_hold("x", 1).alias("s"), arrays.resample("x", 5).alias("r"), arrays.trailing("x", 2).alias("l"), arrays.first_index_of_max("x").alias("m")).first()
    assert (r.t, r.p, r.s, r.r, r.l, r.m) == (4.5, [1, 2, 4, None, None], [1, 1, 2], [1, 1.5, 2, 3, 4], [2, 4], 2)


def test_schema_aliases_and_nan(spark):
    df = frame(spark, [("1.5", "NaN"), ("abc", "2")], "` IR_Value ` string, RED string")
    out = schema.normalize_columns(df).select(schema.number("ir").alias("ir"), schema.number("red").alias("red")).collect()
    assert [tuple(r) for r in out] == [(1.5, None), (None, 2.0)]
    with pytest.raises(ValueError):
        schema.normalize_columns(df.select("RED"))
    assert schema.no_nan(frame(spark, [(float("nan"),)], "x double")).first().x is None


def test_windows_pad_and_drop(spark):
    s = Sampling(hertz=2.0, window_seconds=5.0)
    rows = [(1, i, float(i), 1.0) for i in range(1, 26)] + [(2, i, float(i), 1.0) for i in range(1, 7)] + [(3, 1, 1.0, 1.0)]
    got = {(r.subject_id, r.win): r.ir for r in windows.automatic_windows(frame(spark, rows, "subject_id long, seq long, ir double, red double"), s).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[2, 0] == [1, 2, 3, 4, 5, 6, 6, 6, 6, 6]


def test_relative_seconds(spark):
    rows = [(1, 1, "00:00:01.500"), (1, 2, "x"), (1, 3, "00:00:02.000"), (2, 1, "7.5"), (2, 2, "8"), (3, 1, "?"), (3, 2, "?")]
    out = windows.relative_seconds(frame(spark, rows, "subject_id long, seq long, t string"), "t", hertz=400.0)
    assert [r.ts for r in out.orderBy("subject_id", "seq").collect()] == [0.0, 0.0, 0.5, 0.0, 0.5, 0.0, 1 / 400]


def test_recordings(spark, tmp_path):
    (tmp_path / "subject_007_Win2.csv").write_text("Timestamp,IR_Value,Red_Value\n0.0,1,2\n0.5,bad,2\n1.0,3,4\n")
    out = readings.read_recordings(spark, str(tmp_path / "*.csv")).orderBy("seq").collect()
    assert [(r.subject, r.win, r.ir, r.red, r.ts) for r in out] == [("subject_007", 2, 1.0, 2.0, 0.0), ("subject_007", 2, 3.0, 4.0, 1.0)]
    doc = tmp_path / "a.json"
    doc.write_text('{"Metadata": {"Status": "SUCCESS", "Sampling_Rate_Fs": 400}}')
    assert readings.read_documents(spark, str(doc)).first().hertz == 400.0


def test_label_join_takes_the_first(spark):
    f = frame(spark, [("A ",), ("b",), ("c",)], "id string")
    lab = frame(spark, [("a", 1, 10.0), (" A", 2, 20.0), ("B", 3, None)], "k string, o long, t double")
    got = {r.id: r.target for r in dataset.label_join(f, lab, "id", "k", "o", "t").collect()}
    assert got == {"A ": 10.0, "b": None, "c": None}
    assert [r.id for r in dataset.unmatched(f, lab, "id", "k").collect()] == ["c"]


def test_store(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = lambda *x: frame(spark, list(x), "subject_id long, v double")
    store.replace_subjects(rows((1, 1.0), (2, 2.0)), p)
    store.replace_subjects(rows((2, 3.0)), p)
    assert {(r.subject_id, r.v) for r in spark.read.parquet(p).collect()} == {(1, 1.0), (2, 3.0)}
    log = str(tmp_path / "log")
    store.append(rows((1, 1.0)), log)
    store.append(rows((1, 2.0)).withColumn("extra", F.lit("x")), log)
    assert store.read_log(spark, log).where("extra IS NULL").count() == 1
    assert store.round_trip(rows((1, 1.0), (2, 2.0)), rows((1, 1.0 + 1e-12), (2, 2.5)), ["subject_id"]).first().n_different == 1
    left = store.delete_subject({"subjects": frame(spark, [(1,), (2,)], "id long"), "predictions": rows((1, 1.0), (2, 2.0))}, frame(spark, [(1,)], "id long"))
    assert left["subjects"].count() == left["predictions"].count() == 1


def test_boosting_engines_learn_and_agree(spark, monkeypatch):
    monkeypatch.setattr(boost, "REWRITE", 3)
    rows = [(float(i % 17), float(i * 7 % 23), None if i % 29 == 0 else float(i % 5), 50.0 + 3 * (i % 17) - 2 * (i * 7 % 23)) for i in range(600)]
    df = frame(spark, rows, "a double, b double, c double, y double")
    s = Boosting(trees=6, rate=0.5, rows=1.0, columns=1.0)
    model = boost.fit(df, ["a", "b", "c"], "y", s)
    m = evaluate.metrics(df.withColumn("p", boost.score_expression(model.nodes, model.base)), "y", "p").first()
    assert m.r2 > 0.8
    import numpy as np

    # in memory, from the same bins, row numbers and thresholds: the same trees
    columns = ["a", "b", "c"]
    cuts = boost.cuts_of(df, columns)
    for s in (s, Boosting(trees=7, rate=0.3)):
        model = boost.fit(df, columns, "y", s)
        part = boost.prepared(df, columns, "y", cuts).toPandas()
        local = boost.fit_arrays(part[columns].to_numpy(float), part["_y"].to_numpy(), part["_w"].to_numpy(float), np.stack(part["_bins"].tolist()), part["_u"].to_numpy(np.int64), columns, cuts, s)
        assert [n[:6] for n in local.nodes] == [n[:6] for n in model.nodes]
        assert np.allclose([n[6] or 0 for n in local.nodes], [n[6] or 0 for n in model.nodes])
    folded = dataset.folds(df, 3, ["a", "b", "y"])
    by_size = [boost.cross_validate(folded, columns, "y", [s], local_rows=n).orderBy("fold").collect() for n in (600, 599)]
    assert [r.n for r in by_size[0]] == [r.n for r in by_size[1]] and sum(r.n for r in by_size[0]) == 600
    assert all(np.allclose([getattr(r, c) for r in by_size[0]], [getattr(r, c) for r in by_size[1]]) for c in ("mae", "rmse", "r2"))
    s = Boosting(trees=6, rate=0.5, rows=1.0, columns=1.0)
    best = boost.sweep(folded, ["a", "b", "c"], "y", "DEPTH", [1, 2], s).where("best").collect()
    assert len(best) == 1
    assert evaluate.topology(frame(spark, model.nodes, schema.NODES)).agg(F.max("depth")).first()[0] <= 2


def test_readings_to_predictions(spark):
    import numpy as np
    from test_kernels import pulse_wave

    wave = pulse_wave(30.0)
    rows = [(1, i + 1, float(v), float(0.9 * v)) for i, v in enumerate(wave)] + [(2, i + 1, 5.0, 5.0) for i in range(6000)]
    df = frame(spark, rows, "subject_id long, seq long, ir double, red double")
    per = pipeline.readings_to_features(df, Settings()).cache()
    got = {(r.subject_id, r.win): r.status for r in per.collect()}
    assert got[1, 0] == got[1, 1] == "SUCCESS" and got[2, 0] != "SUCCESS"
    v = features.vector24(features.subject_average(per))
    assert len(v.columns) == 25 and v.count() == 1
    names = v.columns[1:]
    scaler = frame(spark, [(n, 0.0, 1.0) for n in names], "feature string, center double, scale double")
    model = boost.Model(100.0, [(0, 0, "ir_bpm", 60.0, 1, 2, None, 1.0, 1.0), (0, 1, None, None, None, None, -5.0, None, 1.0), (0, 2, None, None, None, None, 7.0, None, 1.0)])
    out = {r.subject_id: r for r in pipeline.infer(df, model, scaler).collect()}
    assert out[1].prediction == 107.0 and out[1].n_accepted == 2 and out[2].prediction is None and out[2].status == "REJECTED"
    assert np.isfinite(v.first()["ir_bpm"])


def test_count_windows_stream(spark, tmp_path):
    rows = [(s, i, float(i), float(-i)) for i in range(1, 51) for s in (1, 2)]
    src = str(tmp_path / "in")
    frame(spark, rows[:41], "subject_id long, seq long, ir double, red double").coalesce(1).write.parquet(src)
    frame(spark, rows[41:], "subject_id long, seq long, ir double, red double").coalesce(1).write.mode("append").parquet(src)
    raw = spark.readStream.schema("subject_id long, seq long, ir double, red double").option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    sink = stream.fan_out([lambda b, e: seen.extend(b.collect()), lambda b, e: None])
    q = stream.write(stream.count_windows(raw, 16, stop_after=32), sink, str(tmp_path / "state"), "t", None).start()
    q.awaitTermination()
    got = sorted((r.subject_id, r.win, r.ir[0], r.ir[-1]) for r in seen)
    assert got == [(s, w, 16.0 * w + 1, 16.0 * w + 16) for s in (1, 2) for w in (0, 1)]


def test_retrain_and_learning_curve(spark):
    rows = [(float(i), {"a": float(i % 9), "b": float(i % 4)}, 90.0 + 4 * (i % 9)) for i in range(60)]
    df = frame(spark, rows, "id double, features map<string,double>, actual double")
    s = Settings(boosting=Boosting(trees=4, rate=0.5))
    model, scaler, errors = pipeline.retrain(df, ["a", "b"], s)
    assert errors.first().r2 > 0.5 and scaler.count() == 2 and model.nodes
    assert pipeline.retrain(df.limit(5), ["a", "b"], s) is None
    flat = dataset.folds(df.select(F.element_at("features", "a").alias("a"), "actual", "id"), 2, ["id"])
    curve = boost.learning_curve(flat, ["a"], "actual", s.boosting, points=2).orderBy("share").collect()
    assert [r.share for r in curve] == [0.5, 1.0] and curve[1].n == 60


def test_listings(spark, tmp_path):
    import time

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text("a")
    found = store.listing(spark, str(tmp_path))
    before = spark.createDataFrame(found.collect(), found.schema)
    time.sleep(0.05)
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "2.csv").write_text("b")
    (tmp_path / "x" / "1.csv").write_text("aa")
    got = {r.state: r.n for r in store.replaced(before, store.listing(spark, str(tmp_path))).collect()}
    assert got == {"fresh": 1, "replaced": 1}
    assert store.latest_folder(spark, str(tmp_path), "2.csv").first().folder.endswith("/y")


def test_percentiles_are_exact(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 4000
    values = {"even": rng.random(n), "heavy": np.round(rng.pareto(0.3, n), 3), "ties": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.5), "none": np.full(n, np.nan)}
    rows = [tuple(None if np.isnan(values[c][i]) or (c == "even" and i % 5 == 0) else float(values[c][i]) for c in values) for i in range(n)]
    df = frame(spark, rows, ", ".join(f"{c} double" for c in values)).repartition(3)
    points = (0.0, 0.25, 0.5, 0.753, 1.0)
    for few, buckets in ((20_000, 4096), (10, 8), (1, 2)):
        monkeypatch.setattr(dataset, "FEW", few)
        monkeypatch.setattr(dataset, "BUCKETS", buckets)
        got = dataset.percentiles(df, list(values), points)
        for k, c in enumerate(values):
            there = [r[k] for r in rows if r[k] is not None]
            assert np.allclose(got[c], np.quantile(there, points), rtol=1e-12) if there else got[c] == [None] * 5
    assert dataset.impute(df, ["none"], 1.5).agg(F.sum("none")).first()[0] == 1.5 * n


def test_recordings_and_documents(spark, tmp_path):
    from pulsegrid.sources import readings

    for folder, sign in (("x", 1), ("y", -1)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "Ann_Win3.csv").write_text("Timestamp, IR_Value ,red\n" + "".join(f"{i / 10},{sign * i},{i}\n" for i in range(5)) + "bad,x,1\n")
        (tmp_path / folder / "c.json").write_text('{"Run": [{"Metadata": {"Source_File": "a \\"b\\".csv", "Status": "REJECTED"}}, {"sampling_rate_fs": 4e2}], "hyperparameters": {"k": 1}}')
    rows = readings.read_recordings(spark, [str(tmp_path / "x" / "*.csv"), str(tmp_path / "y" / "*.csv")]).collect()
    assert len({r.recording for r in rows}) == 2 and {(r.subject, r.win) for r in rows} == {("Ann", 3)}
    for end in ("x", "y"):
        mine = sorted((r.seq, r.ir, r.red) for r in rows if r.recording.split("/")[-2] == end)
        assert mine == [(i + 1, (i if end == "x" else -i), i) for i in range(5)]
    docs = readings.read_documents(spark, str(tmp_path / "x" / "*.json")).first()
    assert (docs.source_file, docs.status, docs.hertz) == ('a "b".csv', "REJECTED", 400.0)


def test_artefacts(spark, tmp_path):
    from test_kernels import pulse_wave

    wave = pulse_wave()
    rows = [(1, 0, wave.tolist(), (0.9 * wave).tolist()), (2, 0, [1.0] * 40, [1.0] * 40), (3, 0, [1.0] * 10, [1.0] * 10)]
    w = frame(spark, rows, "subject_id long, win long, ir array<double>, red array<double>")
    got = {r.subject_id: r for r in features.artefacts(w).collect()}
    assert got[1].status == "SUCCESS" and len(got[1].ir_high) == 6000 and len(got[1].red_velocity) == 220
    assert got[2].status == got[3].status == "FAILED" and got[3].ir_high is None
    store.write_artefacts(features.artefacts(w), features.window_features(w), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a" / "full")).where("subject_id = 1").count() == 6000
    assert spark.read.parquet(str(tmp_path / "a" / "ensemble")).count() == 220
    assert spark.read.text(str(tmp_path / "a" / "config")).count() == 3
    stages = features.stage_diagnostics(w).groupBy("subject_id").agg(F.count("*").alias("n"), F.count("ir_skewness").alias("known")).collect()
    assert {(r.subject_id, r.n) for r in stages} == {(1, 6), (2, 6), (3, 6)} and {r.known for r in stages if r.subject_id == 3} == {0}
    assert features.summaries(w).count() == 6
    short = {r.subject_id: r.reason for r in features.window_features(w).collect()}
    assert short[2] == short[3] == "fewer than 50 samples"


def test_a_cluster_must_name_a_shared_folder():
    import pytest

    from pulsegrid import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)


def test_trees_do_not_depend_on_partitions(spark):
    """Cuts of skewed, repeated and missing values, and the trees grown from them, with 1 and 16 partitions."""
    rng = np.random.default_rng(3)
    n = 3000
    frame_ = pd.DataFrame({"a": rng.lognormal(size=n) ** 4, "b": rng.integers(0, 5, n).astype(float), "c": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))})
    frame_["y"] = np.log(frame_.a) + frame_.b + rng.normal(size=n) / 10
    df = spark.createDataFrame(frame_).withColumn("c", F.nanvl("c", F.lit(None).cast("double")))
    one, many = df.coalesce(1), df.repartition(16)
    cuts = [boost.cuts_of(d, ["a", "b", "c"]) for d in (one, many)]
    assert all(np.array_equal(x, y) for x, y in zip(*cuts, strict=True))
    assert cuts[0][1].tolist() == [0.0, 1.0, 2.0, 3.0, 4.0]
    shares = np.searchsorted(np.sort(frame_.a), cuts[0][0], "right") / n
    assert len(shares) > 50 and np.abs(shares - np.arange(1, 64)[: len(shares)] / 64).max() < 0.02
    models = [boost.fit(d, ["a", "b", "c"], "y", Boosting(trees=3)) for d in (one, many)]
    same = lambda m: [tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in node) for node in m.nodes]
    assert same(models[0]) == same(models[1])


def test_rows_of_an_array_query_are_held_for_few_windows():
    """What a worker gives out at once stays small, however many windows an Arrow batch has."""
    from pulsegrid.plans import kernel_queries as k

    class Windows:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    run = k.per_array(Windows(), "j long", lambda x: [(j,) for j in range(3)])
    sizes = [len(p) for p in run(iter([pd.DataFrame({"subject_id": range(2000), "win": 0, "ir": [[1.0]] * 2000})]))]
    assert sum(sizes) == 6000 and max(sizes) <= 3 * k.BATCH


def test_trees_are_fitted_from_chunks(spark, monkeypatch):
    """A pass over the rows is one over chunks of bytes; their histograms are those of the rows, missing, NaN and weighted ones, too."""
    monkeypatch.setattr(boost, "CHUNK", 100)
    rng = np.random.default_rng(5)
    n = 1000
    rows = [(None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(v), float(i % 3), None if i % 50 == 0 else float(v * 2)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "a double, b double, y double").coalesce(1)
    cuts, s = boost.cuts_of(df, ["a", "b"]), Boosting(high_value=1.0)
    weight = boost.sample_weight("y", s)
    chunks = boost.packed(df, ["a", "b"], "y", cuts, 0.25, weight)
    assert 1 < chunks.count() <= 10
    part = boost.prepared(df, ["a", "b"], "y", cuts, weight).toPandas()
    bins, g = np.stack(part["_bins"].tolist()), part["_w"] * (0.25 - part["_y"])
    a, b, c = line = boost._line(s, 4)
    taken = ((part["_u"].astype("int64") * a + b) % boost.PRIME < c).to_numpy()
    splits = [(0, 0, 20, 1)]  # node 0 by the bins of a; its two children are open
    got = {(r._node, r._f, r._b): (r.g, r.h) for r in boost._histograms(chunks, 2, [0, 1], [], splits, [1, 2], line).collect()}
    want: dict = {}
    for i in np.flatnonzero(taken):
        for f in range(2):
            old = want.setdefault((1 + int(bins[i, 0] > 20), f, int(bins[i, f])), (0.0, 0.0))
            want[(1 + int(bins[i, 0] > 20), f, int(bins[i, f]))] = old[0] + g[i], old[1] + part["_w"][i]
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
