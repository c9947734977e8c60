"""Adaptive alert severity from rule history and resolution times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.clock import at, before, seconds_between
from fleetsight.functions.ordered import rank_in_time
from fleetsight.functions.severity import step_severity

NOISE_COUNT = 5
NOISE_SECONDS = 15 * 60
RARE_SECONDS = 60 * 60
FAST_MS = 5 * 60_000
SLOW_MS = 30 * 60_000


def rule_history(alerts: DataFrame, as_of, window_seconds: float = NOISE_SECONDS, rule: str = "rule_name", time: str = "seen_at") -> DataFrame:
    """Per rule: alerts inside the trailing noise window, first one of them, and the last one overall.

    Only alerts strictly before ``as_of`` count, so a rule's first alert is really unseen.
    """
    ts = F.col(time)
    prior = alerts.filter(ts < at(as_of))
    inside = ts > before(as_of, window_seconds)
    return prior.groupBy(F.col(rule).alias("rule")).agg(
        F.count_if(inside).alias("count"),
        F.min(F.when(inside, ts)).alias("first_seen"),
        F.max(ts).alias("last_seen"),
    )


def adaptive_severity(
    alerts: DataFrame,
    history: DataFrame,
    as_of,
    resolution: DataFrame | None = None,
    rule: str = "rule_name",
    noise_seconds: float = NOISE_SECONDS,
    rare_seconds: float = RARE_SECONDS,
) -> DataFrame:
    """Unseen and rare rules step up; noisy, fast-resolving rules step down.

    ``history`` has one row per rule (see ``rule_history``); ``resolution`` maps rule to its mean resolution
    time in ms. A missing mean counts as 0, which is fast.
    """
    stats = history.withColumnRenamed("rule", "__rule")
    rows = alerts.join(stats, F.col(rule) == F.col("__rule"), "left")
    if resolution is not None:
        mean = resolution.select(F.col("rule").alias("__r2"), F.col("avg_resolution_ms"))
        rows = rows.join(mean, F.col(rule) == F.col("__r2"), "left").drop("__r2")
    else:
        rows = rows.withColumn("avg_resolution_ms", F.lit(None).cast("double"))
    ms = F.coalesce("avg_resolution_ms", F.lit(0.0))
    unseen = F.col("__rule").isNull()
    rare = seconds_between(at(as_of), F.col("last_seen")) > rare_seconds
    noisy = (F.col("count") > NOISE_COUNT) & (seconds_between(at(as_of), F.col("first_seen")) < noise_seconds)
    quiet = noisy & ((ms < FAST_MS) | (ms == 0)) & ~(ms > SLOW_MS)
    delta = F.when(unseen | rare, "boosted").when(F.coalesce(quiet, F.lit(False)), "suppressed").otherwise("nominal")
    sev = F.col("severity")
    rows = rows.withColumn("severity_delta", delta)
    d = F.col("severity_delta")
    rows = rows.withColumn("adaptive_severity", F.when(d == "boosted", step_severity(sev, 1)).when(d == "suppressed", step_severity(sev, -1)).otherwise(sev))
    return rows.withColumn("suppression_count", F.coalesce("count", F.lit(0))).drop("__rule", "count", "first_seen", "last_seen", "avg_resolution_ms")


def rolling_resolution(log: DataFrame, chunk_seconds: int = 86400) -> DataFrame:
    """Rolling mean per rule where each new time counts half: 0 -> x, else (prev + x) / 2.

    The fold is a weighted sum: with n positive times the i-th weighs 2^-(n-i+1), the first 2^-(n-1). Ranks come
    from the chunked ranking, so a rule with very many resolutions is never one ordered group. Leading zeros do
    not count (a zero mean is replaced), later ones halve the mean; weights below 2^-1000 are zero in a double.
    """
    positive = log.filter(F.col("resolution_time_ms") > 0).groupBy("rule").agg(F.min(F.struct("resolved_at", "incident_id")).alias("start"))
    rows = log.join(positive, "rule", "left").filter(F.col("start").isNotNull() & (F.struct("resolved_at", "incident_id") >= F.col("start")))
    ranked = rank_in_time(rows.drop("start"), ["rule"], "resolved_at", "incident_id", chunk_seconds, out="i", total="n")
    power = F.least(F.col("n") - F.col("i") + F.when(F.col("i") == 1, 0).otherwise(1), F.lit(1000))
    weight = F.pow(F.lit(0.5), power.cast("double"))
    means = ranked.groupBy("rule").agg(F.sum(F.col("resolution_time_ms") * weight).alias("avg_resolution_ms"))
    zeros = log.select("rule").distinct().join(means, "rule", "left")
    return zeros.withColumn("avg_resolution_ms", F.coalesce("avg_resolution_ms", F.lit(0.0)))
