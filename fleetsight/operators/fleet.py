"""Fleet list, failing hosts, health scores and host summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.clock import before, in_window
from fleetsight.functions.coerce import bounded_limit, js_round
from fleetsight.functions.ordered import latest_per_key
from fleetsight.functions.severity import event_health_level
from fleetsight.operators.shaping import host_status

HOUR = 3600


def _status(rows: DataFrame, as_of) -> DataFrame:
    return rows.withColumn(
        "status",
        host_status(F.col("critical_count"), F.col("cpu_usage_percent"), F.col("memory_usage_percent"), F.col("last_seen"), as_of),
    )


def fleet_from_snapshots(heartbeats: DataFrame, snapshots: DataFrame, as_of, critical_seconds: float = HOUR, limit: int | None = None) -> DataFrame:
    """Heartbeats with the total of all snapshots and the criticals of the last hour.

    Both totals come from one conditional aggregate, so the snapshot table is read and shuffled once.
    """
    recent = in_window(F.col("snapshot_time"), as_of, critical_seconds)
    counts = snapshots.groupBy("system_id").agg(
        F.sum("total_events").alias("total_events"),
        F.sum(F.when(recent, F.col("critical_count"))).alias("critical_count"),
    )
    return _fleet(heartbeats, counts, as_of, limit)


def fleet_from_events(
    heartbeats: DataFrame, events: DataFrame, as_of, total_seconds: float = 24 * HOUR, critical_seconds: float = HOUR, limit: int | None = None
) -> DataFrame:
    """The same list straight from events, for a fleet that has no snapshots yet."""
    recent = in_window(F.col("ingested_at"), as_of, critical_seconds)
    rows = events.filter(in_window(F.col("ingested_at"), as_of, total_seconds))
    counts = rows.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(recent & (F.col("severity") == "CRITICAL")).alias("critical_count"),
    )
    return _fleet(heartbeats, counts, as_of, limit)


def _fleet(heartbeats: DataFrame, counts: DataFrame, as_of, limit: int | None) -> DataFrame:
    rows = heartbeats.join(counts, "system_id", "left").withColumns(
        {
            "total_events": F.coalesce("total_events", F.lit(0)),
            "critical_count": F.coalesce("critical_count", F.lit(0)),
        }
    )
    rows = _status(rows, as_of)
    return rows.orderBy("system_id").limit(limit) if limit else rows


def fleet(heartbeats: DataFrame, snapshots: DataFrame, events: DataFrame, as_of, **kw) -> DataFrame:
    """Snapshots if any host has a positive total, else events (decided by a one-row existence test)."""
    usable = snapshots.filter(F.col("total_events") > 0).join(heartbeats.select("system_id"), "system_id", "left_semi")
    if usable.limit(1).count():
        return fleet_from_snapshots(heartbeats, snapshots, as_of, **kw)
    return fleet_from_events(heartbeats, events, as_of, **kw)


def failing_hosts(events: DataFrame, heartbeats: DataFrame, as_of=None, window_minutes: int | None = None, limit=6) -> DataFrame:
    """Hosts by number of CRITICAL and ERROR events, top k.

    The events are counted per host before the join, so the join sees one row per host and a hot host costs
    nothing extra.
    """
    rows = events.filter(F.col("severity").isin("CRITICAL", "ERROR"))
    if window_minutes:
        rows = rows.filter(in_window(F.col("ingested_at"), as_of, window_minutes * 60, inclusive=True))
    counts = rows.groupBy("system_id").agg(F.count(F.lit(1)).alias("failure_count"))
    named = counts.join(heartbeats.select("system_id", F.col("hostname").alias("hb_name")), "system_id", "left")
    return (
        named.select("system_id", F.coalesce("hb_name", "system_id").alias("hostname"), "failure_count")
        .orderBy(F.col("failure_count").desc(), F.col("system_id"))
        .limit(bounded_limit(limit, 6))
    )


def identity_conflicts(heartbeats: DataFrame) -> DataFrame:
    """Host names reported by more than one system (counted, and listed one row per system)."""
    pairs = heartbeats.select("hostname", "system_id").distinct()
    shared = pairs.groupBy("hostname").agg(F.count(F.lit(1)).alias("systems"), F.min("system_id").alias("first_system"))
    return shared.filter(F.col("systems") > 1)


def identity_conflict_members(heartbeats: DataFrame) -> DataFrame:
    pairs = heartbeats.select("hostname", "system_id").distinct()
    return pairs.join(identity_conflicts(heartbeats).select("hostname", "systems"), "hostname")


def host_summaries(events: DataFrame) -> DataFrame:
    """Counts, newest event, health score 5·critical + 2·error + warning and its level."""
    grouped = events.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        F.max(F.struct("ingested_at", "id")).alias("newest"),
    )
    score = F.col("critical_count") * 5 + F.col("error_count") * 2 + F.col("warning_count")
    return grouped.select(
        "system_id",
        "event_count",
        "critical_count",
        "error_count",
        "warning_count",
        score.alias("health_score"),
        event_health_level(score).alias("health_level"),
        F.col("newest.id").alias("latest_event_id"),
        F.col("newest.ingested_at").alias("latest_event_at"),
    )


def top_hosts_by_volume(events: DataFrame, k: int = 6) -> DataFrame:
    return (
        events.groupBy("hostname")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.col("events").desc(), F.col("hostname"))
        .limit(k)
    )


def health_heatmap(systems: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every system with its event summary, zeros and ``healthy`` when it had none."""
    rows = systems.select("system_id", "hostname").join(summaries, "system_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("event_count", "critical_count", "error_count", "warning_count", "health_score")}
    return rows.withColumns(zeros | {"health_level": F.coalesce("health_level", F.lit("healthy"))})


def health_scores(events: DataFrame, systems: DataFrame, as_of, window_seconds: float = 300) -> DataFrame:
    """Score per system from the current and the previous window, both in one aggregate."""
    ts = F.col("ingested_at")
    now = ts > before(as_of, window_seconds)
    rows = events.filter(ts > before(as_of, 2 * window_seconds))

    def count(sev: str, inside):
        return F.count_if(inside & (F.col("severity") == sev))

    counts = rows.groupBy("system_id").agg(
        count("CRITICAL", now).alias("c"), count("ERROR", now).alias("e"), count("WARNING", now).alias("w"), count("CRITICAL", ~now).alias("p")
    )
    joined = systems.select("system_id", "hostname").join(counts, "system_id", "left").fillna(0, ["c", "e", "w", "p"])
    c, p = F.col("c"), F.col("p")
    worse = (
        F.when((p > 0) & (c > p * 1.5), F.least((c - p) * 2, F.lit(10)))
        .when((p == 0) & (c >= 3), F.lit(5))
        .otherwise(F.lit(0))
    )
    score = F.lit(100) - F.least(c * 10, F.lit(40)) - F.least(F.col("e") * 4, F.lit(30)) - F.least(F.col("w"), F.lit(20)) - worse
    return joined.select("system_id", "hostname", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint").alias("health_score"))


def fleet_health(scores: DataFrame) -> DataFrame:
    """Rounded mean over systems, 100 for an empty fleet."""
    return scores.agg(F.coalesce(js_round(F.avg("health_score")), F.lit(100)).cast("bigint").alias("fleet_health"))


def mean_cpu(systems: DataFrame) -> DataFrame:
    return systems.agg(F.coalesce(F.avg(F.col("cpu_usage_percent").cast("double")), F.lit(0.0)).alias("avg_cpu"))


def status_counts(systems: DataFrame) -> DataFrame:
    return systems.agg(
        F.count(F.lit(1)).alias("systems"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("online", "degraded", "offline")],
    )


def kpi_strip(systems: DataFrame, alerts: DataFrame, incidents: DataFrame, signals: DataFrame) -> DataFrame:
    """All strip counters. Each input is reduced to one row first; the rows are stacked and summed, not crossed."""
    names = ["systems", "online", "degraded", "offline", "active_alerts", "incidents", "critical_incidents", "ml_incidents", "signals"]
    parts = [
        status_counts(systems),
        alerts.agg(F.count_if(~F.coalesce("acknowledged", F.lit(False))).alias("active_alerts")),
        incidents.agg(
            F.count(F.lit(1)).alias("incidents"),
            F.count_if(F.col("severity") == "CRITICAL").alias("critical_incidents"),
            F.count_if(F.col("trigger") != "signal").alias("ml_incidents"),
        ),
        signals.agg(F.count(F.lit(1)).alias("signals")),
    ]
    stacked = None
    for part in parts:
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def merge_trends(snapshots: DataFrame, metrics: DataFrame, keep: int = 100) -> DataFrame:
    """Points per (host, time), a snapshot beating a metric point, newest ``keep`` per host.

    The priority is an aggregate (min_by), and the newest-N has a partial limit before its shuffle.
    """
    cols = ["system_id", "snapshot_time", "cpu_usage_percent", "memory_usage_percent", "disk_free_percent"]
    both = snapshots.select(*cols, F.lit(0).alias("prio")).unionByName(metrics.select(*cols, F.lit(1).alias("prio")))
    reading = F.struct(*cols[2:])
    merged = both.groupBy("system_id", "snapshot_time").agg(F.min_by(reading, "prio").alias("r"), F.min("prio").alias("prio"))
    points = merged.select("system_id", "snapshot_time", "r.*", F.when(F.col("prio") == 0, "snapshot").otherwise("metrics").alias("origin"))
    return latest_per_key(points, ["system_id"], F.col("snapshot_time").desc(), n=keep)


def trend_stats(points: DataFrame) -> DataFrame:
    return points.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.avg(F.col("cpu_usage_percent").cast("double")).alias("cpu_avg"),
        F.greatest(F.max("cpu_usage_percent"), F.lit(0)).cast("double").alias("cpu_peak"),
        F.avg(F.col("memory_usage_percent").cast("double")).alias("memory_avg"),
        F.least(F.min("disk_free_percent"), F.lit(100)).cast("double").alias("disk_min"),
    )


def cluster_summary(predictions: DataFrame) -> DataFrame:
    """Systems and anomalies per cluster, unclassified last."""
    return (
        predictions.groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("systems"), F.count_if(F.col("is_anomaly")).alias("anomalies"))
        .orderBy(F.col("cluster_id").asc_nulls_last())
    )


def anomaly_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count_if(F.col("is_anomaly")).alias("anomaly_count"),
        (F.count(F.lit(1)) - F.count_if(F.col("is_anomaly"))).alias("normal_count"),
        F.countDistinct(F.nullif("model_version", F.lit(""))).alias("models"),
        F.countDistinct("cluster_id").alias("clusters"),
    )


def cluster_members(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy(
        F.col("cluster_id").asc_nulls_last(), F.coalesce("is_anomaly", F.lit(False)).desc(), F.col("anomaly_score").desc_nulls_last(), F.col("system_id")
    )


def latest_predictions(predictions: DataFrame, limit: int | None = None, only_anomalies: bool = False) -> DataFrame:
    """Newest prediction per host; with ``only_anomalies`` the newest anomalous one."""
    rows = predictions.filter("is_anomaly") if only_anomalies else predictions
    newest = latest_per_key(rows, ["system_id"], F.col("prediction_time").desc())
    shaped = newest.withColumns(
        {
            "anomaly_score": F.coalesce("anomaly_score", F.lit(0)),
            "failure_probability": F.coalesce("failure_probability", F.lit(0)),
            "predicted_fault": F.coalesce(F.nullif("predicted_fault", F.lit("")), F.lit("NONE")),
            "model_version": F.coalesce(F.nullif("model_version", F.lit("")), F.lit("unknown")),
        }
    )
    return shaped.orderBy("system_id").limit(limit) if limit else shaped
