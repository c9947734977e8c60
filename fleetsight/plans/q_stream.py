"""Batch forms of the stateful operators (T-4, T-5) and of the live windows (T-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.operators import alerts, ingest, resource_events
from fleetsight.plans.oracle_views import EPOCH
from fleetsight.plans.q_alerts import ALERT_OUT, acknowledgements
from fleetsight.plans.registry import query
from fleetsight.streaming import alert_state, jobs


@query("t02_live_signals", f"""
SELECT time_bucket(INTERVAL '2 minutes', ingested_at, {EPOCH}) AS bucket, system_id, fault_type, coalesce(fault_subtype, 'general') AS fault_subtype, count(*) AS count FROM tel GROUP BY 1, 2, 3, 4""")
def _(t):
    # The streaming definition runs on a batch frame as well; the watermark is ignored there.
    return jobs.signal_stream(t.tel).select("bucket", "system_id", "fault_type", "fault_subtype", "count")


@query("t02_live_metrics", f"""
SELECT time_bucket(INTERVAL '5 minutes', ingested_at, {EPOCH}) AS bucket, count(*) AS event_count, count(*) FILTER (WHERE severity='CRITICAL') AS critical_count, count(*) FILTER (WHERE severity='ERROR') AS error_count,
 count(*) FILTER (WHERE severity='WARNING') AS warning_count, count(*) FILTER (WHERE severity='INFO') AS info_count FROM tel GROUP BY 1""")
def _(t):
    return jobs.metric_stream(t.tel)


@query("t04_unique_events", "SELECT fault_type, count(DISTINCT h) AS events FROM (SELECT fault_type, sha256(system_id || fault_type || CAST(CAST(ingested_at AS DATE) AS VARCHAR)) AS h FROM tel) x GROUP BY 1")
def _(t):
    rows = t.tel.select("id", "fault_type", F.sha2(F.concat("system_id", "fault_type", F.date_format("ingested_at", "yyyy-MM-dd")), 256).alias("event_hash"))
    return ingest.unseen_events(rows, ["id"]).groupBy("fault_type").agg(F.count(F.lit(1)).alias("events"))


@query("t05_resource_events", """
WITH RECURSIVE d AS (SELECT id, system_id, ingested_at, severity, cpu_usage_percent AS c, memory_usage_percent AS m, disk_free_percent AS f, abs(cpu_usage_percent - lag(cpu_usage_percent) OVER w) AS dc,
  abs(memory_usage_percent - lag(memory_usage_percent) OVER w) AS dm, abs(disk_free_percent - lag(disk_free_percent) OVER w) AS dd FROM tel WINDOW w AS (PARTITION BY system_id ORDER BY ingested_at, id)),
 k AS (SELECT id, system_id, ingested_at, CAST(round_even(c, 1) AS VARCHAR) || '/' || CAST(m AS VARCHAR) || '/' || CAST(f AS VARCHAR) AS h, row_number() OVER (PARTITION BY system_id ORDER BY ingested_at, id) AS n
  FROM d WHERE severity = 'INFO' AND (dc > 5 OR dm > 5 OR dd > 3)),
 g AS (SELECT system_id, n, id, true AS ok, ingested_at AS last, [h] AS seen FROM k WHERE n = 1
  UNION ALL SELECT k.system_id, k.n, k.id, k.ingested_at - g.last >= INTERVAL 3 DAYS AND NOT list_contains(g.seen, k.h), CASE WHEN k.ingested_at - g.last >= INTERVAL 3 DAYS AND NOT list_contains(g.seen, k.h) THEN k.ingested_at ELSE g.last END,
   CASE WHEN k.ingested_at - g.last >= INTERVAL 3 DAYS AND NOT list_contains(g.seen, k.h) THEN list_append(g.seen, k.h) ELSE g.seen END FROM g JOIN k ON k.system_id = g.system_id AND k.n = g.n + 1)
SELECT system_id, id FROM g WHERE ok""")
def _(t):
    deltas = ingest.metric_deltas(t.tel, "ingested_at", "id")
    rows = resource_events.change_candidates(deltas, F.col("severity") == "INFO")
    return resource_events.rate_limited(rows, 3 * 86400).select("system_id", F.col("tie").alias("id"))


@query("t06_alert_state", "SELECT alert_key, occurrence_count, first_seen_at, last_seen_at, source_event_id FROM alerts")
def _(t):
    rows = alerts.roll_up(alerts.native_candidates(t.tel))
    return rows.select("alert_key", "occurrence_count", "first_seen_at", "last_seen_at", "source_event_id")


@query("t06_alert_state_with_acks", f"SELECT {ALERT_OUT} FROM acked_alerts")
def _(t):
    """The stream itself, run to completion over several micro-batches of the recorded candidates and acknowledgements."""
    candidates = alerts.native_candidates(t.tel)
    return alert_state.replayed_alerts(candidates, acknowledgements(candidates)).select(*[c.strip() for c in ALERT_OUT.split(",")])
