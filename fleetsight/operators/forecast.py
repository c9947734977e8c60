"""Failure forecasts and score trends from prediction history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.functions.clock import duration_label
from fleetsight.functions.coerce import clamp, js_round
from fleetsight.functions.ordered import latest_per_key, neighbour_in_time

# Fixed values of the forecast.
SAMPLE_SECONDS = 30
FAILURE_AT = 0.90
SLOPE = 0.05
MAX_SAMPLES = 120
HISTORY = 10


def prediction_history(predictions: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Newest ``keep`` predictions per host, one per prediction time."""
    unique = predictions.groupBy("system_id", "prediction_time").agg(
        F.max("anomaly_score").cast("double").alias("anomaly_score"), F.max("failure_probability").cast("double").alias("failure_probability")
    )
    return latest_per_key(unique, ["system_id"], F.col("prediction_time").desc(), n=keep, rank="newest_no")


def latest_cpu(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("system_id").agg(F.max_by("cpu_usage_percent", "snapshot_time").alias("cpu_now"))


def _hundredths(c: Column) -> Column:
    return js_round(c * 100) / 100


def forecasts(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per host: slope and fit of the failure probability over its samples, time to failure, confidence, risk."""
    place = Window.partitionBy("system_id").orderBy("prediction_time")
    indexed = history.withColumn("x", (F.row_number().over(place) - 1).cast("double"))
    fit = indexed.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("samples"),
        # Rounded so that the limits below do not depend on the order of a floating-point sum.
        F.round(F.regr_slope("failure_probability", "x"), 12).alias("slope"),
        F.round(F.regr_r2("failure_probability", "x"), 12).alias("r2"),
        F.max_by(F.struct("failure_probability", "anomaly_score"), "prediction_time").alias("now"),
    )
    rows = fit.join(latest_cpu(snapshots), "system_id", "left")
    p, a = clamp(F.col("now.failure_probability"), 0.0, 1.0), clamp(F.col("now.anomaly_score"), 0.0, 1.0)
    single = F.col("samples") < 2
    slope = F.coalesce("slope", F.lit(0.0))
    r2 = clamp(F.coalesce("r2", F.lit(0.0)), 0.0, 1.0)
    trend = F.when(single, "stable").when(slope > SLOPE, "rising").when(slope < -SLOPE, "falling").otherwise("stable")
    needed = F.when(~single & (slope > 0) & (p < FAILURE_AT), (F.lit(FAILURE_AT) - p) / slope)
    ttf = F.when((needed > 0) & (needed < MAX_SAMPLES), duration_label(needed * SAMPLE_SECONDS))
    boost = F.when(F.col("cpu_now") > 85, 0.05).otherwise(0.0)
    full = F.least(r2 * 0.40 + p * 0.35 + a * 0.25 + boost, F.lit(1.0))
    conf = _hundredths(F.when(single, p / 2).otherwise(full))
    rows = rows.select(
        "system_id", "samples", trend.alias("trend"), p.alias("failure_prob_now"), ttf.alias("time_to_failure"), conf.alias("forecast_conf")
    )
    rising = F.col("trend") == "rising"
    risk = (
        F.when((F.col("failure_prob_now") > 0.80) | (rising & F.col("time_to_failure").isNotNull()), "imminent")
        .when((F.col("failure_prob_now") > 0.60) | rising, "elevated")
        .otherwise("nominal")
    )
    return rows.withColumn("risk_level", risk)


def ordered_forecasts(rows: DataFrame) -> DataFrame:
    rank = F.when(F.col("risk_level") == "imminent", 0).when(F.col("risk_level") == "elevated", 1).otherwise(2)
    return rows.orderBy(rank, "system_id")


def trend_label(now: Column, prev: Column, step: float = 0.05) -> Column:
    return F.when(now > prev + step, "rising").when(now < prev - step, "falling").otherwise("stable")


def score_trends(predictions: DataFrame, chunk_seconds: int = 7 * 86400) -> DataFrame:
    """Each prediction with the direction of its anomaly score against the host's previous one."""
    rows = predictions.withColumn("__tie", F.lit(0))
    linked = neighbour_in_time(rows, ["system_id"], "prediction_time", "__tie", {"prev_score": "anomaly_score"}, chunk_seconds)
    now, prev = F.col("anomaly_score").cast("double"), F.col("prev_score").cast("double")
    return linked.drop("__tie").withColumn("trend", trend_label(now, prev))


def latest_trends(predictions: DataFrame) -> DataFrame:
    """Newest prediction per host with its trends; only two rows per host are shuffled."""
    two = latest_per_key(predictions, ["system_id"], F.col("prediction_time").desc(), n=2, rank="r")
    first, second = F.col("r") == 1, F.col("r") == 2

    def pick(c: str, at: Column) -> Column:
        return F.max(F.when(at, F.col(c)))

    rows = two.groupBy("system_id").agg(
        pick("prediction_time", first).alias("prediction_time"),
        pick("anomaly_score", first).cast("double").alias("anomaly_score"),
        pick("failure_probability", first).cast("double").alias("failure_probability"),
        pick("predicted_fault", first).alias("predicted_fault"),
        pick("anomaly_score", second).cast("double").alias("prev_anomaly"),
        pick("failure_probability", second).cast("double").alias("prev_risk"),
    )
    return rows.withColumns(
        {
            "anomaly_trend": trend_label(F.col("anomaly_score"), F.col("prev_anomaly")),
            "risk_trend": trend_label(F.col("failure_probability"), F.col("prev_risk")),
        }
    ).drop("prev_anomaly", "prev_risk")
