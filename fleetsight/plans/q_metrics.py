"""Metrics, KPIs, distributions, ingest health (A-2 .. A-11, A-22, A-28, A-31, P-18, P-26, S-19, S-20)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from fleetsight.functions.clock import at
from fleetsight.operators import fleet, metrics, report, shaping
from fleetsight.plans.oracle_views import EPOCH, mean
from fleetsight.plans.registry import query
from fleetsight.sources.adapter import DAY

COUNTS = """count(*) AS event_count, count(*) FILTER (WHERE severity='CRITICAL') AS critical_count,
 count(*) FILTER (WHERE severity='ERROR') AS error_count, count(*) FILTER (WHERE severity='WARNING') AS warning_count,
 count(*) FILTER (WHERE severity='INFO') AS info_count"""
MEANS = f"""{mean("cpu_usage_percent", 1)} AS avg_cpu, {mean("memory_usage_percent", 1)} AS avg_memory, {mean("disk_free_percent", 1)} AS avg_disk_free"""
AS_OF = "(SELECT as_of FROM clk)"


@query("a02_bucketed_metrics", f"""
SELECT date_trunc('hour', ingested_at) AS bucket, {COUNTS}, {MEANS} FROM tel
WHERE ingested_at >= TIMESTAMP '2024-01-03' AND ingested_at <= TIMESTAMP '2024-01-28' GROUP BY 1""")
def _(t):
    from datetime import datetime

    return metrics.bucketed_metrics(t.tel, start=datetime(2024, 1, 3), end=datetime(2024, 1, 28))


@query("a02_metrics_15min", f"""
SELECT time_bucket(INTERVAL '15 minutes', ingested_at, {EPOCH}) AS bucket, {COUNTS}, {MEANS} FROM tel
WHERE ingested_at > {AS_OF} - INTERVAL 30 DAYS GROUP BY 1""")
def _(t):
    return metrics.bucketed_metrics(t.tel, t.as_of, 30 * 1440, bucket_seconds=900)


@query("a02_metrics_last_6h", f"""
SELECT time_bucket(INTERVAL '15 minutes', ingested_at, {EPOCH}) AS bucket, {COUNTS}, {MEANS} FROM tel
WHERE ingested_at > {AS_OF} - INTERVAL 6 HOURS GROUP BY 1""")
def _(t):
    return metrics.bucketed_metrics(t.tel, t.as_of, 360)


@query("a02b_snapshot_rollup", f"""
SELECT date_trunc('hour', snapshot_time) AS bucket, CAST(sum(total_events) AS BIGINT) AS event_count,
 CAST(sum(critical_count) AS BIGINT) AS critical_count, CAST(sum(error_count) AS BIGINT) AS error_count,
 CAST(sum(warning_count) AS BIGINT) AS warning_count, CAST(sum(info_count) AS BIGINT) AS info_count, {MEANS}
FROM snaps1 WHERE snapshot_time > {AS_OF} - INTERVAL 30 DAYS GROUP BY 1""")
def _(t):
    return metrics.snapshot_metrics(t.snaps(), t.as_of, 30 * DAY)


@query("a03_kpis", f"""
SELECT count(*) AS total_events, count(*) FILTER (WHERE severity='CRITICAL') AS critical_events,
 count(*) FILTER (WHERE severity='WARNING') AS warning_events FROM tel WHERE ingested_at >= {AS_OF} - INTERVAL 1 DAY""")
def _(t):
    return metrics.kpis(t.tel, t.as_of, 1440)


@query("a03_kpis_from_snapshots", """
SELECT CAST(sum(total_events) AS BIGINT) AS total_events, CAST(sum(critical_count) AS BIGINT) AS critical_events,
 CAST(sum(warning_count) AS BIGINT) AS warning_events FROM snaps1""")
def _(t):
    # The events side is empty (a window after the newest event), so the snapshots answer.
    return metrics.kpis_or_snapshots(t.tel, t.snaps(), t.as_of + timedelta(days=2), 60)


@query("a04_fault_distribution", "SELECT fault_type, count(*) AS count FROM tel GROUP BY 1")
def _(t):
    return metrics.distribution(t.tel, "fault_type")


@query("a04_subtype_distribution", f"""
SELECT fault_subtype, count(*) AS count FROM tel WHERE ingested_at >= {AS_OF} - INTERVAL 10 DAYS GROUP BY 1""")
def _(t):
    return metrics.distribution(t.tel, "fault_subtype", t.as_of, 10 * 1440)


@query("a05_severity_distribution", """
SELECT severity, count(*) AS count, CAST(floor(count(*)*100.0/(SELECT count(*) FROM tel) + 0.5) AS BIGINT) AS percent FROM tel GROUP BY 1""")
def _(t):
    return metrics.severity_share(t.tel)


@query("a29_severity_zero_filled", f"""
SELECT s.severity, count(t.id) AS count FROM (VALUES ('CRITICAL'),('ERROR'),('WARNING'),('INFO')) s(severity)
LEFT JOIN (SELECT * FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 2 HOURS) t ON t.severity = s.severity GROUP BY 1""")
def _(t):
    recent = t.tel.filter(F.col("ingested_at") > at(t.as_of - timedelta(hours=2)))
    return metrics.severity_counts_zero_filled(recent)


@query("a29_top_fault_types", "SELECT fault_type, count(*) AS count FROM tel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return metrics.top_values(t.tel, "fault_type", 5)


@query("l03_top_hosts_by_volume", "SELECT hostname, count(*) AS events FROM tel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def _(t):
    return fleet.top_hosts_by_volume(t.tel)


@query("a07_fleet_averages", f"""
SELECT {mean("cpu_usage_percent", 1)} AS avg_cpu, {mean("memory_usage_percent", 1)} AS avg_memory, {mean("disk_free_percent", 1)} AS avg_disk
FROM hb WHERE last_seen > {AS_OF} - INTERVAL 1 DAY""")
def _(t):
    return metrics.fleet_averages(t.hb, t.tel, t.as_of, heartbeat_seconds=DAY)


@query("a07_fleet_averages_fallback", f"""
SELECT {mean("cpu_usage_percent", 1)} AS avg_cpu, {mean("memory_usage_percent", 1)} AS avg_memory, {mean("disk_free_percent", 1)} AS avg_disk
FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 3 DAYS""")
def _(t):
    # No heartbeat is newer than as_of + 1 day, so the events of the window decide.
    return metrics.fleet_averages(t.hb, t.tel, t.as_of + timedelta(days=1), heartbeat_seconds=DAY / 2, event_seconds=4 * DAY)


EXPORT_SQL = f"""
SELECT CAST(sum(total_events) AS BIGINT) AS total_events, CAST(sum(critical_count) AS BIGINT) AS critical_events,
 CAST(sum(error_count) AS BIGINT) AS error_events, CAST(sum(warning_count) AS BIGINT) AS warning_events,
 CAST(sum(info_count) AS BIGINT) AS info_events, {mean("cpu_usage_percent", 2)} AS avg_cpu, {mean("memory_usage_percent", 2)} AS avg_memory,
 {mean("disk_free_percent", 2)} AS avg_disk_free, count(DISTINCT system_id) AS total_systems,
 (SELECT count(DISTINCT system_id) FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 2 HOURS) AS online_systems
FROM snaps1"""


@query("a08_export_totals", EXPORT_SQL)
def _(t):
    return metrics.export_totals(t.snaps(), t.tel, t.as_of)


@query("a08_export_totals_from_events", f"""
SELECT count(*) AS total_events, count(*) FILTER (WHERE severity='CRITICAL') AS critical_events,
 count(*) FILTER (WHERE severity='ERROR') AS error_events, count(*) FILTER (WHERE severity='WARNING') AS warning_events,
 count(*) FILTER (WHERE severity='INFO') AS info_events, {mean("cpu_usage_percent", 2)} AS avg_cpu, {mean("memory_usage_percent", 2)} AS avg_memory,
 {mean("disk_free_percent", 2)} AS avg_disk_free, count(DISTINCT system_id) AS total_systems,
 (SELECT count(DISTINCT system_id) FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 2 HOURS) AS online_systems
FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 1 DAY""")
def _(t):
    return metrics.export_totals_from_events(t.tel, t.as_of)


@query("s19_exposition_lines", f"""
WITH e AS ({EXPORT_SQL}), m AS (
 SELECT unnest([1,2,3,4,5,6,7,8,9,10]) AS n, unnest(['total_events','critical_events','error_events','warning_events','info_events','avg_cpu','avg_memory','avg_disk_free','total_systems','online_systems']) AS name,
  unnest(['Total telemetry events.','CRITICAL severity events.','ERROR severity events.','WARNING severity events.','INFO severity events.','Average CPU usage percent.','Average memory usage percent.','Average disk free percent.','Total distinct systems.','Systems active in last 2 hours.']) AS help,
  unnest((SELECT [CAST(total_events AS VARCHAR), CAST(critical_events AS VARCHAR), CAST(error_events AS VARCHAR), CAST(warning_events AS VARCHAR), CAST(info_events AS VARCHAR),
    CAST(avg_cpu AS VARCHAR), CAST(avg_memory AS VARCHAR), CAST(avg_disk_free AS VARCHAR), CAST(total_systems AS VARCHAR), CAST(online_systems AS VARCHAR)] FROM e)) AS v)
SELECT CAST(3*(n-1) AS BIGINT) AS line_no, '# HELP fleet_' || name || ' ' || help AS line FROM m
UNION ALL SELECT CAST(3*(n-1)+1 AS BIGINT), '# TYPE fleet_' || name || ' gauge' FROM m
UNION ALL SELECT CAST(3*(n-1)+2 AS BIGINT), 'fleet_' || name || ' ' || v FROM m""")
def _(t):
    return metrics.exposition_lines(metrics.export_totals(t.snaps(), t.tel, t.as_of))


@query("a09_throughput", f"""
WITH w AS (SELECT *, ingested_at > {AS_OF} - INTERVAL 1 DAY AS cur FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 2 DAYS),
 r AS (SELECT count(*) FILTER (WHERE cur) AS n1, (epoch_us(max(ingested_at) FILTER (WHERE cur)) - epoch_us(min(ingested_at) FILTER (WHERE cur)))/1000000.0 AS s1,
   count(*) FILTER (WHERE NOT cur) AS n0, (epoch_us(max(ingested_at) FILTER (WHERE NOT cur)) - epoch_us(min(ingested_at) FILTER (WHERE NOT cur)))/1000000.0 AS s0,
   count(*) FILTER (WHERE ingested_at > {AS_OF} - INTERVAL 3 HOURS) AS wr FROM w),
 q AS (SELECT *, CASE WHEN s1 > 0 THEN round(n1/s1, 1) ELSE 0 END AS eps, CASE WHEN s0 > 0 THEN n0/s0 ELSE 0 END AS prev FROM r)
SELECT CAST(eps AS DOUBLE) AS events_per_sec, CAST(CASE WHEN prev > 0 THEN round_even((eps - prev)/prev*100, 0) ELSE 0 END AS BIGINT) AS eps_change_pct,
 CAST(round(wr/60.0, 1) AS DOUBLE) AS db_write_rate, CAST(0 AS BIGINT) AS ingest_lag, 'Optimal' AS lag_status FROM q""")
def _(t):
    return metrics.throughput(t.tel, t.as_of, DAY, 3 * 3600)


@query("a10_mean_gap", f"""
SELECT CAST(round(avg(epoch_us(ingested_at) - epoch_us(p))/1000.0, 0) AS BIGINT) AS avg_latency_ms FROM (
 SELECT ingested_at, lag(ingested_at) OVER (PARTITION BY system_id ORDER BY ingested_at) AS p FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 10 DAYS) x
WHERE p IS NOT NULL""")
def _(t):
    return metrics.mean_gap(t.tel, t.as_of, 10 * DAY)


TREND_SQL = f"""
SELECT time_bucket(INTERVAL '1 hour', ingested_at, {EPOCH}) AS bucket, count(*) AS count, CAST(round(avg(epoch_us(ingested_at) - epoch_us(p))/1000.0, 0) AS BIGINT) AS gap_ms
FROM (SELECT ingested_at, lag(ingested_at) OVER (ORDER BY ingested_at) AS p FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 30 DAYS) x
WHERE p IS NOT NULL GROUP BY 1"""


@query("a11_minute_trend", TREND_SQL)
def _(t):
    return metrics.minute_trend(t.tel, t.as_of, 30 * DAY, 3600)


@query("a11_trend_with_default", f"""
WITH m AS ({TREND_SQL}), g AS (SELECT CAST(round(avg(epoch_us(ingested_at) - epoch_us(p))/1000.0, 0) AS BIGINT) AS d FROM (
 SELECT ingested_at, lag(ingested_at) OVER (PARTITION BY system_id ORDER BY ingested_at) AS p FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 10 DAYS) x WHERE p IS NOT NULL)
SELECT bucket, count, CASE WHEN gap_ms > 0 THEN gap_ms ELSE (SELECT d FROM g) END AS gap_ms FROM m""")
def _(t):
    return metrics.minute_trend_with_default(metrics.minute_trend(t.tel, t.as_of, 30 * DAY, 3600), metrics.mean_gap(t.tel, t.as_of, 10 * DAY))


@query("a22_adaptive_buckets", f"""
SELECT time_bucket(INTERVAL '15 minutes', ingested_at, {EPOCH}) AS bucket, {COUNTS},
 round(avg(CAST(cpu_usage_percent AS DOUBLE)), 6) AS avg_cpu, round(avg(CAST(memory_usage_percent AS DOUBLE)), 6) AS avg_memory, round(avg(CAST(disk_free_percent AS DOUBLE)), 6) AS avg_disk_free
FROM tel WHERE ingested_at >= {AS_OF} - INTERVAL 1 DAY GROUP BY 1""")
def _(t):
    rows = metrics.adaptive_buckets(t.tel, t.as_of, 1440)
    return rows.withColumns({c: F.round(c, 6) for c in ("avg_cpu", "avg_memory", "avg_disk_free")})


@query("a31_facet_faults", "SELECT DISTINCT fault_type FROM tel")
def _(t):
    return metrics.facet_faults(t.tel)


@query("a31_facet_systems", "SELECT DISTINCT system_id, hostname FROM hb")
def _(t):
    return metrics.facet_systems(t.hb)


@query("p18_freshness", f"SELECT 'DEGRADED' AS status, CAST(120 AS BIGINT) AS delay_seconds FROM tel HAVING max(ingested_at) = {AS_OF}")
def _(t):
    return shaping.freshness(t.tel, t.as_of + timedelta(seconds=120))


@query("p26_resource_series", """
SELECT system_id, ingested_at AS time, CAST(cpu_usage_percent AS DOUBLE) AS cpu, CAST(memory_usage_percent AS DOUBLE) AS memory, CAST(disk_free_percent AS DOUBLE) AS disk
FROM tel WHERE severity IN ('CRITICAL','ERROR')""")
def _(t):
    return shaping.resource_series(shaping.dashboard_events(t.tel, t.as_of, 40 * DAY, severities=["CRITICAL", "ERROR"]))


@query("p26_severity_series", f"""
SELECT date_trunc('hour', ingested_at) AS time, count(*) FILTER (WHERE severity='CRITICAL') AS critical, count(*) FILTER (WHERE severity='ERROR') AS error,
 count(*) FILTER (WHERE severity='WARNING') AS warning, count(*) FILTER (WHERE severity='INFO') AS info
FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 30 DAYS GROUP BY 1""")
def _(t):
    return shaping.severity_series(metrics.bucketed_metrics(t.tel, t.as_of, 30 * 1440))


@query("s20_summary_report", f"""
SELECT '{{"generated_at":"' || strftime({AS_OF}, '%Y-%m-%dT%H:%M:%S.%f') || '","dashboard_metrics":{{"total_events":' || CAST((SELECT count(*) FROM tel) AS VARCHAR) || ',"critical_events":'
 || CAST((SELECT count(*) FROM tel WHERE severity='CRITICAL') AS VARCHAR) || ',"warning_events":' || CAST((SELECT count(*) FROM tel WHERE severity='WARNING') AS VARCHAR) || '}},"system_failures":['
 || (SELECT string_agg(j, ',' ORDER BY c DESC, j) FROM (
   SELECT e.system_id, count(*) AS c, '{{"system_id":"' || e.system_id || '","hostname":"' || coalesce(h.hostname, e.system_id) || '","failure_count":' || CAST(count(*) AS VARCHAR) || '}}' AS j
   FROM tel e LEFT JOIN hb h ON h.system_id = e.system_id WHERE e.severity IN ('CRITICAL','ERROR') GROUP BY e.system_id, h.hostname ORDER BY c DESC, e.system_id LIMIT 6) f)
 || ']}}' AS report""")
def _(t):
    return report.summary_report(metrics.kpis(t.tel, t.as_of), fleet.failing_hosts(t.tel, t.hb), at(t.as_of))
