"""Feature snapshots, fleet lists, host health, heartbeats (A-1, A-18, A-20, A-24, A-27, J-*, P-14 .. P-24, W-*)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from fleetsight.functions.clock import seconds_between
from fleetsight.functions.severity import anomaly_tier, event_health_level, health_tier
from fleetsight.operators import features, fleet, ingest, shaping
from fleetsight.plans.oracle_views import EPOCH, mean
from fleetsight.plans.registry import query
from fleetsight.sources.adapter import DAY

AS_OF = "(SELECT as_of FROM clk)"
SNAP_OUT = """snapshot_time, CAST(cpu_usage_percent AS DOUBLE) AS cpu_usage_percent, CAST(memory_usage_percent AS DOUBLE) AS memory_usage_percent,
 CAST(disk_free_percent AS DOUBLE) AS disk_free_percent, total_events, critical_count, error_count, warning_count, info_count, dominant_fault_type, avg_confidence"""


def stats_sql(where: str) -> str:
    return f"""
 SELECT b.*, d.fault_type AS dominant_fault_type FROM (
  SELECT system_id, count(*) AS total_events, count(*) FILTER (WHERE severity='CRITICAL') AS critical_count, count(*) FILTER (WHERE severity='ERROR') AS error_count,
   count(*) FILTER (WHERE severity='WARNING') AS warning_count, count(*) FILTER (WHERE severity='INFO') AS info_count,
   {mean("coalesce(confidence_score, CAST(0.20 AS DECIMAL(3,2)))", 2)} AS avg_confidence
  FROM tel WHERE {where} GROUP BY 1) b
 JOIN (SELECT * FROM (SELECT system_id, fault_type, row_number() OVER (PARTITION BY system_id ORDER BY count(*) DESC, fault_type) AS r
   FROM tel WHERE {where} GROUP BY 1, 2) c WHERE r = 1) d ON d.system_id = b.system_id"""


LOOKBACK = f"ingested_at > {AS_OF} - INTERVAL 7 DAYS"


@query("a01_feature_stats", f"SELECT * FROM ({stats_sql(LOOKBACK)}) s WHERE system_id IN (SELECT system_id FROM hb)")
def _(t):
    return features.feature_stats(t.tel, t.as_of, 7 * DAY, systems=t.hb)


@query("a01_feature_stats_all_hosts", stats_sql("true"))
def _(t):
    return features.feature_stats(t.tel, t.as_of, 40 * DAY)


@query("a01_host_stats", f"SELECT * EXCLUDE (system_id) FROM ({stats_sql(LOOKBACK)}) s WHERE system_id = 'SYS-0007'")
def _(t):
    return features.host_feature_stats(t.tel, "SYS-0007", t.as_of, 7 * DAY)


SNAPSHOT_SQL = f"""
SELECT h.system_id, {AS_OF} AS snapshot_time, CAST(h.cpu_usage_percent AS DOUBLE) AS cpu_usage_percent, CAST(h.memory_usage_percent AS DOUBLE) AS memory_usage_percent,
 CAST(h.disk_free_percent AS DOUBLE) AS disk_free_percent, coalesce(s.total_events, 0) AS total_events, coalesce(s.critical_count, 0) AS critical_count,
 coalesce(s.error_count, 0) AS error_count, coalesce(s.warning_count, 0) AS warning_count, coalesce(s.info_count, 0) AS info_count,
 coalesce(s.dominant_fault_type, 'NONE') AS dominant_fault_type, coalesce(s.avg_confidence, 0.20) AS avg_confidence
FROM hb h LEFT JOIN ({stats_sql(f"ingested_at > {AS_OF} - INTERVAL 1 DAY")}) s ON s.system_id = h.system_id"""


@query("a01b_snapshot_cycle", SNAPSHOT_SQL)
def _(t):
    return features.snapshot_cycle(t.hb, t.tel, t.as_of, DAY)


@query("j03_zero_filled_stats", f"""
SELECT h.system_id, coalesce(s.total_events, 0) AS total_events, coalesce(s.dominant_fault_type, 'NONE') AS dominant_fault_type, CAST(coalesce(s.avg_confidence, 0.20) AS DOUBLE) AS avg_confidence
FROM hb h LEFT JOIN ({stats_sql(f"ingested_at > {AS_OF} - INTERVAL 6 HOURS")}) s ON s.system_id = h.system_id""")
def _(t):
    rows = features.zero_filled(t.hb, features.feature_stats(t.tel, t.as_of, 6 * 3600))
    return rows.select("system_id", "total_events", "dominant_fault_type", "avg_confidence")


@query("j04_semi_join_hosts", "SELECT id, system_id, severity FROM tel WHERE system_id IN (SELECT system_id FROM hb)")
def _(t):
    return t.tel.join(t.hb.select("system_id"), "system_id", "left_semi").select("id", "system_id", "severity")


@query("t03_windowed_snapshots", f"SELECT system_id, {SNAP_OUT} FROM snaps1")
def _(t):
    return t.snaps()


@query("t03_sliding_snapshots", f"""
SELECT t.system_id, w.w AS snapshot_time, count(*) AS total_events, count(*) FILTER (WHERE severity='CRITICAL') AS critical_count
FROM tel t JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS w) w
 ON t.ingested_at >= w.w AND t.ingested_at < w.w + INTERVAL 2 DAYS GROUP BY 1, 2""")
def _(t):
    rows = features.windowed_snapshots(t.tel, 2 * DAY, DAY)
    return rows.select("system_id", "snapshot_time", "total_events", "critical_count")


@query("p23_read_snapshots", f"SELECT system_id, {SNAP_OUT} FROM snaps1 ORDER BY snapshot_time DESC, system_id LIMIT 100")
def _(t):
    return features.read_snapshots(t.snaps(), limit=100)


@query("l02_training_batch", "SELECT system_id, snapshot_time, total_events FROM snaps1 ORDER BY snapshot_time DESC, system_id LIMIT 100")
def _(t):
    return features.training_batch(t.snaps()).select("system_id", "snapshot_time", "total_events")


def fleet_sql(counts: str) -> str:
    return f"""
SELECT h.system_id, h.hostname, CAST(h.cpu_usage_percent AS DOUBLE) AS cpu_usage_percent, CAST(h.memory_usage_percent AS DOUBLE) AS memory_usage_percent,
 CAST(h.disk_free_percent AS DOUBLE) AS disk_free_percent, h.last_seen, CAST(coalesce(c.total_events, 0) AS BIGINT) AS total_events,
 CAST(coalesce(c.critical_count, 0) AS BIGINT) AS critical_count,
 CASE WHEN epoch_us({AS_OF}) - epoch_us(h.last_seen) > 120000000 THEN 'offline'
  WHEN coalesce(c.critical_count,0) >= 3 OR h.cpu_usage_percent > 90 OR h.memory_usage_percent > 95 THEN 'degraded' ELSE 'online' END AS status
FROM hb h LEFT JOIN ({counts}) c ON c.system_id = h.system_id"""


@query("j01_fleet_list", fleet_sql(f"""
SELECT system_id, sum(total_events) AS total_events, sum(critical_count) FILTER (WHERE snapshot_time > {AS_OF} - INTERVAL 3 DAYS) AS critical_count FROM snaps1 GROUP BY 1"""))
def _(t):
    return fleet.fleet_from_snapshots(t.hb, t.snaps(), t.as_of, critical_seconds=3 * DAY)


@query("j01b_fleet_list_from_events", fleet_sql(f"""
SELECT system_id, count(*) AS total_events, count(*) FILTER (WHERE severity='CRITICAL' AND ingested_at > {AS_OF} - INTERVAL 3 DAYS) AS critical_count
FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 7 DAYS GROUP BY 1"""))
def _(t):
    return fleet.fleet_from_events(t.hb, t.tel, t.as_of, 7 * DAY, 3 * DAY)




@query("p16_host_status", f"""
SELECT h.system_id, CASE WHEN epoch_us({AS_OF}) - epoch_us(h.last_seen) > 120000000 THEN 'offline'
 WHEN coalesce(c.n,0) >= 3 OR h.cpu_usage_percent > 90 OR h.memory_usage_percent > 95 THEN 'degraded' ELSE 'online' END AS status
FROM hb h LEFT JOIN (SELECT system_id, count(*) AS n FROM tel WHERE severity='CRITICAL' GROUP BY 1) c ON c.system_id = h.system_id""")
def _(t):
    crit = t.tel.groupBy("system_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("n"))
    rows = t.hb.join(crit, "system_id", "left")
    status = shaping.host_status(F.col("n"), F.col("cpu_usage_percent"), F.col("memory_usage_percent"), F.col("last_seen"), t.as_of)
    return rows.select("system_id", status.alias("status"))


@query("p17_live_status", f"""
SELECT system_id, hostname, CAST(cpu_usage_percent AS DOUBLE) AS cpu_usage_percent, CAST(memory_usage_percent AS DOUBLE) AS memory_usage_percent,
 CAST(disk_free_percent AS DOUBLE) AS disk_free_percent, last_seen, epoch_us({AS_OF}) - epoch_us(last_seen) <= 6*3600000000 AS online FROM hb""")
def _(t):
    return shaping.live_status(t.hb, t.as_of, 6 * 3600)


@query("t07_liveness", f"""
SELECT system_id, (epoch_us({AS_OF}) - epoch_us(last_seen))/1000000.0 AS age_seconds, epoch_us({AS_OF}) - epoch_us(last_seen) < 7200000000 AS is_alive,
 epoch_us({AS_OF}) - epoch_us(last_seen) > 43200000000 AS is_idle, epoch_us({AS_OF}) - epoch_us(last_seen) > 120000000 AS is_offline FROM hb""")
def _(t):
    return shaping.liveness(t.hb, t.as_of, 7200, 43200)


@query("j02_failing_hosts", f"""
SELECT e.system_id, coalesce(h.hostname, e.system_id) AS hostname, count(*) AS failure_count FROM tel e LEFT JOIN hb h ON h.system_id = e.system_id
WHERE e.severity IN ('CRITICAL','ERROR') AND e.ingested_at >= {AS_OF} - INTERVAL 20 DAYS GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 40""")
def _(t):
    return fleet.failing_hosts(t.tel, t.hb, t.as_of, 20 * 1440, limit=40)


@query("a06_top_failing_systems", """
SELECT e.system_id, coalesce(h.hostname, e.system_id) AS hostname, count(*) AS failure_count FROM tel e LEFT JOIN hb h ON h.system_id = e.system_id
WHERE e.severity IN ('CRITICAL','ERROR') GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 6""")
def _(t):
    return fleet.failing_hosts(t.tel, t.hb)


@query("j10_identity_conflicts", """
SELECT hostname, count(DISTINCT system_id) AS systems, min(system_id) AS first_system FROM hb GROUP BY 1 HAVING count(DISTINCT system_id) > 1""")
def _(t):
    return fleet.identity_conflicts(t.hb)


@query("j10_conflict_members", """
SELECT h.hostname, h.system_id, c.systems FROM hb h JOIN (SELECT hostname, count(*) AS systems FROM hb GROUP BY 1 HAVING count(*) > 1) c ON c.hostname = h.hostname""")
def _(t):
    return fleet.identity_conflict_members(t.hb)


SUMMARY_SQL = """
SELECT b.system_id, event_count, critical_count, error_count, warning_count, 5*critical_count + 2*error_count + warning_count AS health_score,
 CASE WHEN 5*critical_count + 2*error_count + warning_count >= 10 THEN 'critical' WHEN 5*critical_count + 2*error_count + warning_count >= 5 THEN 'error'
  WHEN 5*critical_count + 2*error_count + warning_count >= 2 THEN 'warning' ELSE 'healthy' END AS health_level, l.id AS latest_event_id, l.ingested_at AS latest_event_at
FROM (SELECT system_id, count(*) AS event_count, count(*) FILTER (WHERE severity='CRITICAL') AS critical_count, count(*) FILTER (WHERE severity='ERROR') AS error_count,
  count(*) FILTER (WHERE severity='WARNING') AS warning_count FROM tel WHERE {where} GROUP BY 1) b
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ingested_at DESC, id DESC) AS r FROM tel WHERE {where}) x WHERE r = 1) l ON l.system_id = b.system_id"""
RECENT = "ingested_at >= (SELECT as_of FROM clk) - INTERVAL 1 DAY"


@query("a18_host_summaries", SUMMARY_SQL.replace("{where}", "true"))
def _(t):
    return fleet.host_summaries(t.tel)


@query("j16_health_heatmap", f"""
SELECT h.system_id, h.hostname, coalesce(s.event_count, 0) AS event_count, coalesce(s.critical_count, 0) AS critical_count, coalesce(s.error_count, 0) AS error_count,
 coalesce(s.warning_count, 0) AS warning_count, coalesce(s.health_score, 0) AS health_score, coalesce(s.health_level, 'healthy') AS health_level, s.latest_event_id, s.latest_event_at
FROM hb h LEFT JOIN ({SUMMARY_SQL.replace("{where}", RECENT)}) s ON s.system_id = h.system_id""")
def _(t):
    return fleet.health_heatmap(t.hb, fleet.host_summaries(shaping.dashboard_events(t.tel, t.as_of, DAY)))


HEALTH_SQL = f"""
SELECT h.system_id, h.hostname, CAST(greatest(0, least(100, 100 - least(10*c,40) - least(4*e,30) - least(w,20)
 - CASE WHEN p > 0 AND c > 1.5*p THEN least(2*(c-p),10) WHEN p = 0 AND c >= 3 THEN 5 ELSE 0 END)) AS BIGINT) AS health_score
FROM (SELECT h.system_id, h.hostname, count(*) FILTER (WHERE t.severity='CRITICAL' AND t.cur) AS c, count(*) FILTER (WHERE t.severity='ERROR' AND t.cur) AS e,
  count(*) FILTER (WHERE t.severity='WARNING' AND t.cur) AS w, count(*) FILTER (WHERE t.severity='CRITICAL' AND NOT t.cur) AS p
 FROM hb h LEFT JOIN (SELECT *, ingested_at > {AS_OF} - INTERVAL 3 DAYS AS cur FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 6 DAYS) t ON t.system_id = h.system_id GROUP BY 1, 2) h"""


@query("a20_health_scores", HEALTH_SQL)
def _(t):
    return fleet.health_scores(t.tel, t.hb, t.as_of, 3 * DAY)


@query("a20_fleet_health", f"SELECT CAST(floor(avg(health_score) + 0.5) AS BIGINT) AS fleet_health FROM ({HEALTH_SQL}) s")
def _(t):
    return fleet.fleet_health(fleet.health_scores(t.tel, t.hb, t.as_of, 3 * DAY))


@query("a28_mean_cpu", "SELECT round(avg(CAST(cpu_usage_percent AS DOUBLE)), 6) AS avg_cpu FROM hb")
def _(t):
    return fleet.mean_cpu(t.hb).select(F.round("avg_cpu", 6).alias("avg_cpu"))


@query("a24_cluster_summary", """
SELECT cluster_id, count(*) AS systems, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM (
 SELECT system_id, is_anomaly, CASE WHEN failure_probability > 0 THEN CAST(floor(anomaly_score*10) AS BIGINT) END AS cluster_id FROM preds1) p GROUP BY 1""")
def _(t):
    # Heuristic rows carry no cluster; a score band stands in so that the grouping and the NULL group are exercised.
    band = F.when(F.col("failure_probability") > 0, F.floor(F.col("anomaly_score") * 10).cast("int"))
    return fleet.cluster_summary(t.preds().withColumn("cluster_id", band))


@query("a24_anomaly_summary", """
SELECT count(*) FILTER (WHERE is_anomaly) AS anomaly_count, count(*) FILTER (WHERE NOT is_anomaly) AS normal_count, count(DISTINCT model_version) AS models,
 count(DISTINCT cluster_id) AS clusters FROM preds1""")
def _(t):
    return fleet.anomaly_summary(t.preds())


@query("l06_cluster_members", "SELECT system_id, prediction_time, is_anomaly, anomaly_score FROM preds1")
def _(t):
    return fleet.cluster_members(t.preds()).select("system_id", "prediction_time", "is_anomaly", "anomaly_score")


MERGED_SQL = f"""
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY snapshot_time DESC) AS r FROM (
  SELECT system_id, snapshot_time, cpu_usage_percent, memory_usage_percent, disk_free_percent, origin FROM (
   SELECT *, row_number() OVER (PARTITION BY system_id, snapshot_time ORDER BY origin DESC) AS p FROM (
    SELECT system_id, snapshot_time, cpu_usage_percent, memory_usage_percent, disk_free_percent, 'snapshot' AS origin FROM snaps1
    UNION ALL SELECT system_id, time_bucket(INTERVAL '12 hours', ingested_at, {EPOCH}), max(cpu_usage_percent), max(memory_usage_percent), min(disk_free_percent), 'metrics' FROM tel GROUP BY 1, 2) u) v
  WHERE p = 1) w) x WHERE r <= 100"""


def _merged(t):
    points = t.tel.groupBy("system_id", F.window("ingested_at", "12 hours").alias("w")).agg(
        F.max("cpu_usage_percent").alias("cpu_usage_percent"),
        F.max("memory_usage_percent").alias("memory_usage_percent"),
        F.min("disk_free_percent").alias("disk_free_percent"),
    )
    return fleet.merge_trends(t.snaps(), points.withColumn("snapshot_time", F.col("w.start")))


@query("w07_merged_trends", f"""
SELECT system_id, snapshot_time, CAST(cpu_usage_percent AS DOUBLE) AS cpu_usage_percent, CAST(memory_usage_percent AS DOUBLE) AS memory_usage_percent,
 CAST(disk_free_percent AS DOUBLE) AS disk_free_percent, origin FROM ({MERGED_SQL}) m""")
def _(t):
    return _merged(t)


@query("a27_trend_stats", f"""
SELECT system_id, count(*) AS points, round(avg(CAST(cpu_usage_percent AS DOUBLE)), 6) AS cpu_avg, CAST(max(cpu_usage_percent) AS DOUBLE) AS cpu_peak,
 round(avg(CAST(memory_usage_percent AS DOUBLE)), 6) AS memory_avg, CAST(min(disk_free_percent) AS DOUBLE) AS disk_min FROM ({MERGED_SQL}) m GROUP BY 1""")
def _(t):
    return fleet.trend_stats(_merged(t)).withColumns({c: F.round(c, 6) for c in ("cpu_avg", "memory_avg")})


@query("w03_latest_predictions", """
SELECT system_id, prediction_time, anomaly_score, is_anomaly, failure_probability, predicted_fault, model_version FROM (
 SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY prediction_time DESC) AS r FROM preds1) p WHERE r = 1""")
def _(t):
    return fleet.latest_predictions(t.preds(), limit=None).drop("cluster_id")


@query("w03_latest_anomalies", """
SELECT system_id, prediction_time, anomaly_score, is_anomaly, failure_probability, predicted_fault, model_version FROM (
 SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY prediction_time DESC) AS r FROM preds1 WHERE is_anomaly) p WHERE r = 1""")
def _(t):
    return fleet.latest_predictions(t.preds(), only_anomalies=True).drop("cluster_id")


@query("w01_host_gaps", """
SELECT id, system_id, ingested_at, lag(ingested_at) OVER (PARTITION BY system_id ORDER BY ingested_at, id) AS prev_at FROM tel""")
def _(t):
    return ingest.host_gaps(t.tel).select("id", "system_id", "ingested_at", "prev_at")


@query("w02_stream_gaps", """
SELECT id, ingested_at, lag(ingested_at) OVER (ORDER BY ingested_at, id) AS prev_at FROM tel""")
def _(t):
    from fleetsight.functions.ordered import neighbour_in_time

    rows = t.tel.select("id", "ingested_at").withColumn("all_rows", F.lit(0))
    return neighbour_in_time(rows, ["all_rows"], "ingested_at", "id", {"prev_at": "ingested_at"}).drop("all_rows")


@query("w06_metric_deltas", """
SELECT id, system_id, CAST(dc AS DOUBLE) AS cpu_delta, CAST(dm AS DOUBLE) AS memory_delta, CAST(dd AS DOUBLE) AS disk_delta, dc > 5 OR dm > 5 OR dd > 3 AS changed FROM (
 SELECT id, system_id, coalesce(abs(cpu_usage_percent - lag(cpu_usage_percent) OVER w), 0) AS dc, coalesce(abs(memory_usage_percent - lag(memory_usage_percent) OVER w), 0) AS dm,
  coalesce(abs(disk_free_percent - lag(disk_free_percent) OVER w), 0) AS dd FROM tel WINDOW w AS (PARTITION BY system_id ORDER BY ingested_at, id)) x""")
def _(t):
    return ingest.metric_deltas(t.tel, "ingested_at", "id").select("id", "system_id", "cpu_delta", "memory_delta", "disk_delta", "changed")


@query("p14_filtered_systems", "SELECT system_id, hostname FROM hb WHERE contains(lower(hostname), 'host-1') OR contains(lower(system_id), 'host-1')")
def _(t):
    return shaping.dashboard_systems(t.hb, query="HOST-1").select("system_id", "hostname")


@query("l04_sorted_systems", f"SELECT system_id, status, total_events FROM ({fleet_sql('SELECT system_id, count(*) AS total_events, 0 AS critical_count FROM tel GROUP BY 1')}) f")
def _(t):
    rows = fleet.fleet_from_events(t.hb, t.tel, t.as_of, 40 * DAY, 0)
    return shaping.sort_systems(rows).select("system_id", "status", "total_events")


@query("p24_tiers", f"""
SELECT s.system_id, s.snapshot_time, CASE WHEN p.anomaly_score >= 0.75 THEN 'CRITICAL' WHEN p.anomaly_score >= 0.5 THEN 'HIGH' WHEN p.anomaly_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS anomaly_tier,
 CASE WHEN 100 - 10*s.critical_count >= 85 THEN 'NOMINAL' WHEN 100 - 10*s.critical_count >= 60 THEN 'DEGRADED' WHEN 100 - 10*s.critical_count >= 30 THEN 'IMPAIRED' ELSE 'CRITICAL' END AS health_tier,
 CASE WHEN 5*s.critical_count >= 10 THEN 'critical' WHEN 5*s.critical_count >= 5 THEN 'error' WHEN 5*s.critical_count >= 2 THEN 'warning' ELSE 'healthy' END AS event_level
FROM snaps7 s JOIN preds7 p ON p.system_id = s.system_id AND p.prediction_time = s.snapshot_time""")
def _(t):
    from fleetsight.operators.scoring import heuristic_scores

    rows = heuristic_scores(t.snaps(7 * DAY))
    crit = F.col("critical_count")
    return rows.select(
        "system_id",
        "snapshot_time",
        anomaly_tier(F.col("anomaly_score")).alias("anomaly_tier"),
        health_tier(F.lit(100) - crit * 10).alias("health_tier"),
        event_health_level(crit * 5).alias("event_level"),
    )


@query("p06_time_windows", f"""
SELECT count(*) FILTER (WHERE ingested_at > {AS_OF} - INTERVAL 1 DAY) AS open_day, count(*) FILTER (WHERE ingested_at >= {AS_OF} - INTERVAL 1 DAY) AS closed_day,
 count(*) FILTER (WHERE ingested_at BETWEEN {AS_OF} - INTERVAL 5 DAYS AND {AS_OF} - INTERVAL 1 DAY) AS middle FROM tel""")
def _(t):
    from fleetsight.functions.clock import between, in_window

    ts = F.col("ingested_at")
    return t.tel.agg(
        F.count_if(in_window(ts, t.as_of, DAY)).alias("open_day"),
        F.count_if(in_window(ts, t.as_of, DAY, inclusive=True)).alias("closed_day"),
        F.count_if(between(ts, t.as_of - timedelta(days=5), t.as_of - timedelta(days=1))).alias("middle"),
    )


@query("w12_window_compare", f"""
SELECT system_id, count(*) FILTER (WHERE ingested_at > {AS_OF} - INTERVAL 7 DAYS) AS current_events, count(*) FILTER (WHERE ingested_at <= {AS_OF} - INTERVAL 7 DAYS) AS previous_events
FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 14 DAYS GROUP BY 1""")
def _(t):
    from fleetsight.functions.clock import in_window

    cur = in_window(F.col("ingested_at"), t.as_of, 7 * DAY)
    rows = t.tel.filter(in_window(F.col("ingested_at"), t.as_of, 14 * DAY))
    return rows.groupBy("system_id").agg(F.count_if(cur).alias("current_events"), F.count_if(~cur).alias("previous_events"))


@query("f14_age_labels", f"""
SELECT system_id, CASE WHEN floor(s/60+0.5) < 1 THEN 'now' WHEN floor(s/60+0.5) < 60 THEN CAST(CAST(floor(s/60+0.5) AS BIGINT) AS VARCHAR) || 'm ago' ELSE CAST(CAST(floor(s/60+0.5) AS BIGINT)//60 AS VARCHAR) || 'h ago' END AS age,
 CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN CAST(CAST(floor(s/60) AS BIGINT) AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(CAST(floor(s/3600) AS BIGINT) AS VARCHAR) || 'h' ELSE CAST(CAST(floor(s/86400) AS BIGINT) AS VARCHAR) || 'd' END AS short_age,
 CASE WHEN m < 1 THEN '< 1 min' WHEN m < 60 THEN '~' || CAST(m AS VARCHAR) || ' min' WHEN m % 60 > 0 THEN '~' || CAST(m//60 AS VARCHAR) || 'h ' || CAST(m%60 AS VARCHAR) || 'm' ELSE '~' || CAST(m//60 AS VARCHAR) || 'h' END AS duration
FROM (SELECT *, CAST(floor(s/60+0.5) AS BIGINT) AS m FROM (SELECT system_id, (epoch_us({AS_OF}) - epoch_us(last_seen))/1000000.0 AS s FROM hb) x) y""")
def _(t):
    from fleetsight.functions.clock import age_label, at, duration_label, short_age_label

    s = seconds_between(at(t.as_of), F.col("last_seen"))
    return t.hb.select("system_id", age_label(s).alias("age"), short_age_label(s).alias("short_age"), duration_label(s).alias("duration"))


@query("f15_dates", """
SELECT id, date_trunc('hour', ingested_at) AS hour_start, date_trunc('month', ingested_at) + INTERVAL 1 MONTH AS next_month, round(abs(epoch_us(ingested_at) - epoch_us(TIMESTAMP '2024-01-10'))/60000000.0, 4) AS minutes_away FROM tel""")
def _(t):
    from datetime import datetime

    from fleetsight.functions.clock import at, minutes_between, shift_month

    ts = F.col("ingested_at")
    return t.tel.select(
        "id", F.date_trunc("hour", ts).alias("hour_start"), shift_month(ts, 1).alias("next_month"), F.round(minutes_between(ts, at(datetime(2024, 1, 10))), 4).alias("minutes_away")
    )


def _newest(name, columns, order, limit, k):
    sql = f"SELECT {columns} FROM preds1 ORDER BY prediction_time DESC, system_id DESC LIMIT {k}"

    @query(name, sql)
    def _(t):
        return shaping.newest(t.preds(), "prediction_time", limit, "system_id").select(*[c.strip() for c in columns.split(",")])


_newest("l01_newest_predictions", "system_id, prediction_time, anomaly_score, failure_probability, predicted_fault, model_version", None, "bad", 100)
_newest("l01_anomaly_scores", "system_id, anomaly_score, prediction_time", None, 5000, 5000)
_newest("l01_failure_risk", "system_id, failure_probability, predicted_fault, prediction_time", None, 1000, 1000)


@query("l03_top_anomalies", "SELECT system_id, prediction_time, anomaly_score FROM preds1 ORDER BY anomaly_score DESC, prediction_time DESC, system_id LIMIT 10")
def _(t):
    return t.preds().orderBy(F.col("anomaly_score").desc(), F.col("prediction_time").desc(), "system_id").limit(10).select("system_id", "prediction_time", "anomaly_score")


@query("a30_event_rate_by_minute", f"SELECT time_bucket(INTERVAL '1 minute', ingested_at, {EPOCH}) AS bucket, count(*) AS events FROM tel GROUP BY 1")
def _(t):
    from fleetsight.functions.clock import time_bucket

    return t.tel.groupBy(time_bucket(F.col("ingested_at"), 60).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


