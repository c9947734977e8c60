"""Incidents from signals and predictions: priority, impact, boost, lifecycle, timeline, health index."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.functions.clock import at, before, seconds_between
from fleetsight.functions.coerce import js_round
from fleetsight.functions.ordered import latest_per_key
from fleetsight.functions.severity import severity_rank
from fleetsight.operators.forecast import latest_trends

LABELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
OUT = [
    "incident_key", "incident_id", "title", "fault_type", "severity", "system_id", "systems", "event_count", "confidence",
    "priority_score", "priority_label", "trigger", "lifecycle", "anomaly_score", "failure_prob", "predicted_fault", "trend",
    "created_at",
]


def signal_intensity(n: Column) -> Column:
    """log2(n) / log2(100), between 0 and 1 (0 events count as 0, not minus infinity)."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.least(F.log2(n.cast("double")) / F.log2(F.lit(100.0)), F.lit(1.0)))


def confidence(n: Column, anomaly: Column, failure: Column) -> Column:
    return F.least(signal_intensity(n) * 0.4 + anomaly * 0.3 + failure * 0.3, F.lit(1.0))


def escalated_severity(sev: Column, anomaly: Column, failure: Column) -> Column:
    high = (anomaly > 0.70) | (failure > 0.60)
    return (
        F.when((anomaly > 0.85) | (failure > 0.80), "CRITICAL")
        .when(high & (sev == "WARNING"), "ERROR")
        .when(high & (sev == "ERROR"), "CRITICAL")
        .otherwise(sev)
    )


def priority_score(sev: Column, systems: Column, conf: Column, created: Column, as_of) -> Column:
    points = F.when(sev == "CRITICAL", 40).when(sev == "ERROR", 25).when(sev == "WARNING", 10).otherwise(2)
    age = seconds_between(at(as_of), created)
    recent = F.when(age < 300, 10).when(age < 900, 5).otherwise(0)
    return (points + systems * 2 + js_round(conf * 5) + recent).cast("bigint")


def priority_label(sev: Column, score: Column) -> Column:
    return F.when(sev == "CRITICAL", "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def with_priority(rows: DataFrame, as_of) -> DataFrame:
    score = priority_score(F.col("severity"), F.size("systems"), F.col("confidence"), F.col("created_at"), as_of)
    return rows.withColumn("priority_score", score).withColumn("priority_label", priority_label(F.col("severity"), F.col("priority_score")))


def signals_with_predictions(signals: DataFrame, predictions: DataFrame) -> DataFrame:
    """Signals with the newest prediction of their host (absent scores count as 0)."""
    rows = signals.join(latest_trends(predictions), "system_id", "left")
    return rows.withColumns(
        {
            "anomaly_score": F.coalesce("anomaly_score", F.lit(0.0)),
            "failure_probability": F.coalesce("failure_probability", F.lit(0.0)),
            "anomaly_trend": F.coalesce("anomaly_trend", F.lit("stable")),
        }
    )


def strongest_signals(signals: DataFrame) -> DataFrame:
    """Signals with three or more events, or CRITICAL or ERROR; the newest per (host, fault)."""
    strong = signals.filter((F.col("count") >= 3) | F.col("severity").isin("CRITICAL", "ERROR"))
    newest = latest_per_key(
        strong, ["system_id", "fault_type"], F.col("last_seen").desc(), severity_rank(F.col("severity")).desc(), F.col("signal_id").asc()
    )
    return newest.select(
        F.lit("signal").alias("trigger"),
        "system_id",
        "fault_type",
        "systems",
        F.col("count").alias("n"),
        F.col("severity").alias("base_severity"),
        "signal_id",
        F.lit(None).cast("double").alias("a"),
        F.lit(None).cast("double").alias("f"),
        F.col("last_seen").alias("created_at"),
    )


def risky_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions above 0.7 anomaly or 0.6 failure probability, newest per (host, fault, rule).

    One pass: a row above both limits counts for both rules, then the failure rule yields to an anomaly of the
    same host and fault (at most two rows per key meet in that window).
    """
    typed = predictions.withColumns({c: F.col(c).cast("double") for c in ("anomaly_score", "failure_probability")})
    kinds = F.array_compact(
        F.array(F.when(F.col("anomaly_score") > 0.7, "anomaly"), F.when(F.col("failure_probability") > 0.6, "failure_prob"))
    )
    tagged = typed.withColumn("trigger", F.explode(kinds))
    newest = latest_per_key(tagged, ["system_id", "predicted_fault", "trigger"], F.col("prediction_time").desc())
    both = Window.partitionBy("system_id", "predicted_fault")
    has_anomaly = F.max(F.when(F.col("trigger") == "anomaly", True).otherwise(False)).over(both)
    kept = newest.withColumn("__anom", has_anomaly).filter((F.col("trigger") == "anomaly") | ~F.col("__anom"))
    return kept.select(
        "trigger",
        "system_id",
        F.col("predicted_fault").alias("fault_type"),
        F.array("system_id").alias("systems"),
        F.lit(None).cast("bigint").alias("n"),
        F.lit(None).cast("string").alias("base_severity"),
        F.lit(None).cast("string").alias("signal_id"),
        F.col("anomaly_score").alias("a"),
        F.col("failure_probability").alias("f"),
        F.col("prediction_time").alias("created_at"),
    )


def derive_incidents(signals: DataFrame, predictions: DataFrame, snapshots: DataFrame, as_of) -> DataFrame:
    """Incidents from signals, anomalies and failure risks.

    The three rules are stacked first, already cut to one row per key, and then meet the per-host facts (newest
    prediction with its trends, size of the newest snapshot) in one join each.
    """
    stacked = strongest_signals(signals).unionByName(risky_predictions(predictions))
    sizes = snapshots.groupBy("system_id").agg(F.max_by("total_events", "snapshot_time").alias("total_events"))
    facts = latest_trends(predictions).drop("prediction_time")
    rows = stacked.join(facts, "system_id", "left").join(sizes, "system_id", "left")
    kind, fault = F.col("trigger"), F.col("fault_type")
    sig, anomaly = kind == "signal", kind == "anomaly"
    rows = rows.withColumns(
        {
            "a": F.coalesce("a", "anomaly_score", F.lit(0.0)),
            "f": F.coalesce("f", "failure_probability", F.lit(0.0)),
            "n": F.coalesce("n", F.when(sig, F.lit(None)).otherwise(F.col("total_events")), F.lit(1)),
        }
    )
    a, f, n = F.col("a"), F.col("f"), F.col("n")
    host = F.col("system_id")
    model_severity = F.when(F.when(anomaly, a > 0.85).otherwise(f > 0.80), "CRITICAL").otherwise("ERROR")
    percent = js_round(F.when(anomaly, a).otherwise(f) * 100).cast("string")
    out = rows.select(
        F.concat_ws("::", F.when(sig, "sig").when(anomaly, "anom").otherwise("failprob"), host, fault).alias("incident_key"),
        F.when(sig, F.concat(F.lit("INC-SIG-"), F.col("signal_id")))
        .when(anomaly, F.concat(F.lit("INC-ML-ANOM-"), host))
        .otherwise(F.concat(F.lit("INC-ML-RISK-"), host))
        .alias("incident_id"),
        F.when(sig, F.concat(fault, F.lit(" spike ×"), n.cast("string")))
        .when(anomaly, F.concat(F.lit("ML anomaly: "), fault, F.lit(" ("), percent, F.lit("%)")))
        .otherwise(F.concat(F.lit("Failure risk: "), fault, F.lit(" ("), percent, F.lit("% prob)")))
        .alias("title"),
        "fault_type",
        F.when(sig, escalated_severity(F.col("base_severity"), a, f)).otherwise(model_severity).alias("severity"),
        "system_id",
        "systems",
        n.alias("event_count"),
        confidence(n, a, f).alias("confidence"),
        "trigger",
        F.lit("OPEN").alias("lifecycle"),
        a.alias("anomaly_score"),
        f.alias("failure_prob"),
        F.when(sig, F.col("predicted_fault")).otherwise(fault).alias("predicted_fault"),
        F.coalesce(F.when(kind == "failure_prob", F.col("risk_trend")).otherwise(F.col("anomaly_trend")), F.lit("stable")).alias("trend"),
        "created_at",
    )
    return with_priority(out, as_of).select(*OUT)


def ordered_incidents(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("priority_score").desc(), severity_rank(F.col("severity")).desc(), F.col("created_at").desc(), "incident_key")


def impact(incidents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Mean CPU, error share and dominant fault over the snapshots of the incident's host.

    Snapshots are reduced to one row per host before the join, so an incident never meets a host's whole history.
    """
    share = (F.col("critical_count") + F.col("error_count")) / F.greatest(F.col("total_events"), F.lit(1))
    per_host = snapshots.groupBy("system_id").agg(
        F.avg(F.col("cpu_usage_percent").cast("double")).alias("cpu"),
        F.avg(share.cast("double")).alias("share"),
        F.max_by("dominant_fault_type", F.struct("critical_count", "snapshot_time")).alias("dominant"),
    )
    rows = incidents.join(per_host, "system_id", "left")
    return rows.withColumns(
        {
            "systems_affected": F.size("systems"),
            "avg_cpu": F.concat(js_round(F.coalesce("cpu", F.lit(0.0))).cast("string"), F.lit("%")),
            "error_rate_delta": F.concat(F.lit("+"), js_round(F.coalesce("share", F.lit(0.1)) * 100).cast("string"), F.lit("%")),
            "dominant_fault": F.coalesce("dominant", "fault_type"),
        }
    ).drop("cpu", "share", "dominant")


def forecast_boost(incidents: DataFrame, forecasts: DataFrame) -> DataFrame:
    """+20 points and one label step (never past HIGH) for incidents on a host whose forecast is imminent."""
    imminent = forecasts.filter(F.col("risk_level") == "imminent").select("system_id").distinct().withColumn("__hot", F.lit(True))
    rows = incidents.join(imminent, "system_id", "left")
    hot = F.coalesce("__hot", F.lit(False))
    label = F.col("priority_label")
    stepped = F.when(label == "LOW", "MEDIUM").when(label == "MEDIUM", "HIGH").otherwise(label)
    return rows.withColumns(
        {
            "priority_score": F.col("priority_score") + F.when(hot, 20).otherwise(0),
            "priority_label": F.when(hot, stepped).otherwise(label),
            "boosted": hot,
        }
    ).drop("__hot")


def with_lifecycle(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Lifecycle carried over from the action log (incident_id, state, at); reopening clears the earlier times.

    Everything needed is an aggregate per incident: the newest action and the newest reopening.
    """
    reopened = actions.filter(F.col("state") == "OPEN").groupBy("incident_id").agg(F.max("at").alias("reopened"))
    since = actions.join(reopened, "incident_id", "left").filter(F.col("reopened").isNull() | (F.col("at") >= F.col("reopened")))
    rank = F.when(F.col("state") == "OPEN", 0).when(F.col("state") == "ACKNOWLEDGED", 1).otherwise(2)
    latest = since.groupBy("incident_id").agg(
        F.max_by("state", F.struct(F.col("at"), rank.alias("r"))).alias("state"),
        F.max(F.when(F.col("state") == "ACKNOWLEDGED", F.col("at"))).alias("acknowledged_at"),
        F.max(F.when(F.col("state") == "RESOLVED", F.col("at"))).alias("resolved_at"),
    )
    rows = incidents.join(latest, "incident_id", "left")
    return rows.withColumn("lifecycle", F.coalesce("state", "lifecycle")).drop("state")


def resolution_log(incidents: DataFrame) -> DataFrame:
    """Resolved incidents with the time it took and the path."""
    done = incidents.filter(F.col("lifecycle") == "RESOLVED")
    return done.select(
        "incident_id",
        "fault_type",
        "resolved_at",
        ((F.unix_micros("resolved_at") - F.unix_micros("created_at")) / 1000).cast("bigint").alias("resolution_time_ms"),
        F.when(F.col("acknowledged_at").isNotNull(), "OPEN→ACKNOWLEDGED→RESOLVED").otherwise("OPEN→RESOLVED").alias("lifecycle_path"),
    )


def mean_resolution(log: DataFrame, keep: int | None = None) -> DataFrame:
    """Mean resolution time per fault over all resolutions, or the newest ``keep``."""
    newest = log.orderBy(F.col("resolved_at").desc(), F.col("incident_id")).limit(keep) if keep else log
    return newest.groupBy("fault_type").agg(F.count(F.lit(1)).alias("resolutions"), F.avg("resolution_time_ms").alias("avg_resolution_ms"))


def remediation_rates(log: DataFrame, keep: int | None = None) -> DataFrame:
    """Share of successful outcomes per hook over all entries, or the newest ``keep``."""
    newest = log.orderBy(F.col("at").desc(), F.col("incident_id"), F.col("hook_id")).limit(keep) if keep else log
    return newest.groupBy("hook_id").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)).alias("success_rate")
    )


def timeline(incidents: DataFrame, events: DataFrame, window_seconds: int = 600, keep: int = 12, since: datetime | None = None) -> DataFrame:
    """First ``keep`` events within the window around each incident on its host, in time order, with a causal mark.

    The interval join gets an equi key (host, time slot): an incident goes to its slot and both neighbours, an
    event to its own. A causal event is followed, inside the cut list, by another fault within two minutes. ``since`` is a
    time no incident was created before, if the caller knows one: with it the scan of the events is pruned.
    """
    if since is not None:
        events = events.filter(F.col("ingested_at") >= before(since, window_seconds))
    slot = F.floor(F.unix_micros("created_at") / F.lit(window_seconds * 1_000_000)).cast("bigint")
    left = incidents.select("incident_key", "system_id", "created_at", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    right = events.select(
        "system_id", "id", "fault_type", "severity", "ingested_at", F.floor(F.unix_micros("ingested_at") / F.lit(window_seconds * 1_000_000)).cast("bigint").alias("slot")
    )
    near = left.join(right, ["system_id", "slot"]).filter(
        F.abs(F.unix_micros("ingested_at") - F.unix_micros("created_at")) <= window_seconds * 1_000_000
    )
    cut = latest_per_key(near, ["incident_key"], F.col("ingested_at").asc(), F.col("id").asc(), n=keep, rank="position")
    place = Window.partitionBy("incident_key").orderBy("position")
    gap = F.unix_micros(F.lead("ingested_at").over(place)) - F.unix_micros("ingested_at")
    other = F.lead("fault_type").over(place) != F.col("fault_type")
    causal = F.coalesce(other & (gap < 120_000_000), F.lit(False))
    return cut.select("incident_key", "position", "id", "fault_type", "severity", "ingested_at", causal.alias("is_causal"))


def system_health_index(incidents: DataFrame, signals: DataFrame, predictions: DataFrame) -> DataFrame:
    """100 - 10·incidents - 0.5·spikes - 30·risky predictions, rounded, within 0..100. Three one-row sums are stacked."""
    risky = (F.col("anomaly_score") > 0.7) | (F.col("failure_probability") > 0.6)
    parts = (
        incidents.agg((F.count(F.lit(1)) * 10.0).alias("penalty"))
        .unionByName(signals.agg((F.count_if("is_spike") * 0.5).alias("penalty")))
        .unionByName(predictions.agg((F.count_if(risky) * 30.0).alias("penalty")))
    )
    total = parts.agg(F.sum("penalty").alias("penalty"))
    return total.select(F.greatest(F.lit(0), F.least(F.lit(100), js_round(F.lit(100.0) - F.col("penalty")))).cast("bigint").alias("health_index"))
