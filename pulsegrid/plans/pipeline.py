"""The whole way from samples to predictions, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import Settings
from pulsegrid.functions import scalars
from pulsegrid.operators import boost, dataset, features, windows


def readings_to_features(readings: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Window features of (subject_id, seq, ir, red). One shuffle by subject and window; the kernels run where it ends."""
    s = settings or Settings()
    rows = readings
    if s.dialect == "offline":
        # what is left after the filter is numbered anew
        timed = windows.valid(readings).withColumn("_t", F.timestamp_seconds(F.col("seq") / s.sampling.hertz))
        rows = windows.number_rows(timed, "subject_id", "_t", ("seq",), "hour", "_n").drop("seq", "_t").withColumnRenamed("_n", "seq")
    return features.window_features(windows.automatic_windows(rows, s.sampling), s)


def infer(readings: DataFrame, model: boost.Model, scaler: DataFrame, settings: Settings | None = None) -> DataFrame:
    """subject_id, prediction, class and window counts; a subject without an accepted window has a NULL prediction."""
    s = settings or Settings(dialect="inference")
    per_window = readings_to_features(readings, s)
    vector = features.vector24(features.subject_average(per_window, s.dialect), s.dialect)
    names = [c for c in vector.columns if c != "subject_id"]
    scaled = dataset.scale(vector, scaler, names, s.dialect)
    score = boost.score_expression(model.nodes, model.base, s.floor_service if s.dialect == "service" else None)
    predicted = scaled.select("subject_id", score.alias("prediction"), F.to_json(F.struct(*names)).alias("features"))
    counts = per_window.groupBy("subject_id").agg(F.count_if(F.col("status") == "SUCCESS").alias("n_accepted"), F.count_if(F.col("status") != "SUCCESS").alias("n_rejected"))
    out = counts.join(predicted, "subject_id", "left")
    return out.withColumn("class", scalars.class_right("prediction")).withColumn("status", F.when(F.col("prediction").isNull(), "REJECTED").otherwise("SUCCESS"))


def prepare(labelled: DataFrame, columns: list[str], target: str, factor: float = 1.5) -> DataFrame:
    """Labelled rows with missing values filled and outliers clipped."""
    rows = dataset.drop_unlabelled(labelled, target)
    return dataset.clip_outliers(dataset.impute(rows, columns), columns, factor)


def retrain(predictions: DataFrame, columns: list[str], settings: Settings | None = None, least: int = 10) -> tuple[boost.Model, DataFrame, DataFrame] | None:
    """Model, scaler and training errors from stored predictions with a reference value (features: map of doubles).

    None where fewer than ``least`` rows have one: nothing is made up to fill the gap.
    """
    from pulsegrid.operators.evaluate import metrics

    s = settings or Settings()
    rows = predictions.where(F.col("actual").isNotNull()).select(F.col("actual").alias("target"), *[F.element_at("features", c).alias(c) for c in columns])
    if rows.limit(least).count() < least:
        return None
    ready = prepare(rows, columns, "target", s.iqr_factor)
    scaler = dataset.scaler(ready, columns)
    scaled = dataset.scale(ready, scaler, columns)
    model = boost.fit(scaled, columns, "target", s.boosting, boost.sample_weight("target", s.boosting))
    return model, scaler, metrics(scaled.withColumn("predicted", boost.score_expression(model.nodes, model.base)), "target", "predicted")
