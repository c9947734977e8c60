"""Suggested actions per incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in order: playbook key -> steps (text, command, priority, hook).
PLAYBOOK = {
    "cpu": [
        ("Scale instance / add nodes to cluster", None, "immediate", "scale-instance"),
        ("Identify top CPU-consuming processes", "top -b -n 1 | head -n 15", "immediate", None),
        ("Review recent deployments for regression", None, "investigate", None),
    ],
    "db": [
        ("Check active database connections", "show processlist;", "immediate", "check-db-connections"),
        ("Verify connection pool limits", None, "investigate", None),
        ("Monitor slow queries", None, "monitor", None),
    ],
    "network": [
        ("Check upstream physical connectivity", "ping -c 4 8.8.8.8", "immediate", None),
        ("Verify firewall drop rules", None, "investigate", None),
        ("Monitor packet loss rate", None, "monitor", None),
    ],
    "auth": [
        ("Review auth service brute-force logs", None, "immediate", None),
        ("Check token validity expiration metrics", None, "investigate", None),
    ],
    "crash": [
        ("Check system logs for OOM killer", "dmesg -T | grep -i oom", "immediate", None),
        ("Restart affected service", "systemctl restart service", "immediate", "restart-service"),
    ],
    "anomaly": [
        ("Investigate ML-detected spike context", None, "immediate", "restart-service"),
        ("Compare feature snapshots against baseline", None, "investigate", None),
    ],
    "disk": [
        ("Identify large files / log growth", "du -sh /* | sort -rh | head -20", "immediate", None),
        ("Rotate or archive aged logs", None, "investigate", None),
        ("Monitor disk write rate", None, "monitor", None),
    ],
    "fallback": [
        ("Capture current system state snapshot", None, "immediate", None),
        ("Review recent changes in change log", None, "investigate", None),
        ("Escalate if not resolved within 15 min", None, "monitor", None),
    ],
}


def playbook_key(fault: Column, is_anomaly: Column) -> Column:
    """Anomalies have their own list; else the first key contained in the fault type, else the fallback."""
    lowered = F.lower(fault)
    expr = F.when(is_anomaly, "anomaly")
    for key in PLAYBOOK:
        if key != "fallback":
            expr = expr.when(F.contains(lowered, F.lit(key)), key)
    return expr.otherwise("fallback")


def playbook_table(spark) -> DataFrame:
    rows = [(key, i, *step) for key, steps in PLAYBOOK.items() for i, step in enumerate(steps)]
    return spark.createDataFrame(rows, "playbook string, step_no int, step string, command string, priority string, hook string")


def suggested_actions(incidents: DataFrame, success_rates: DataFrame | None = None) -> DataFrame:
    """Steps per incident, best success rate first (stable), filtered by the priority label.

    LOW keeps monitor steps only, MEDIUM drops them. ``position`` numbers the steps of an incident.
    """
    spark = incidents.sparkSession
    keyed = incidents.select(
        "incident_id", "priority_label", playbook_key(F.col("fault_type"), F.col("trigger") != "signal").alias("playbook")
    )
    steps = keyed.join(F.broadcast(playbook_table(spark)), "playbook")
    if success_rates is not None:
        rates = success_rates.select(F.col("hook_id").alias("hook"), F.col("success_rate"))
        steps = steps.join(rates, "hook", "left")
        rate = F.coalesce("success_rate", F.lit(0.0))
    else:
        rate = F.lit(0.0)
    label, priority = F.col("priority_label"), F.col("priority")
    keep = F.when(label == "LOW", priority == "monitor").when(label == "MEDIUM", priority != "monitor").otherwise(True)
    rows = steps.filter(keep).select("incident_id", "playbook", "step_no", "step", "command", "priority", "hook", rate.alias("rate"))
    best_first = Window.partitionBy("incident_id").orderBy(F.col("rate").desc(), F.col("step_no"))
    return rows.withColumn("position", F.row_number().over(best_first))
