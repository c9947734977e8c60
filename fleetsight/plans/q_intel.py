"""Signals, incidents, correlations, forecasts, playbooks and models (A-19, A-21, A-23, A-25, A-26, I-*, C-*, M-*, J-12 .. J-15, W-4, W-8 .. W-10, P-15, P-25, L-5, U-2, U-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions.clock import at
from fleetsight.operators import alerts, correlation, fleet, forecast, incidents, playbook, scoring, shaping, signals
from fleetsight.plans.oracle_views import EPOCH
from fleetsight.plans.registry import query
from fleetsight.schemas import FOREST_CONTAMINATION, KMEANS_CLUSTERS
from fleetsight.sources.adapter import DAY

AS_OF = "(SELECT as_of FROM clk)"
# The sample telemetry knows no storage or network faults, so its own fault names play those roles.
WORDS = {"db": ("driver", "disk"), "api": ("api", "service", "crash"), "network": ("resource", "drop"), "crash": ("crash", "service"), "auth": ("security",)}


def _signals(t):
    return signals.group_signals(t.tel, t.as_of, DAY, 30 * DAY)


def _incidents(t):
    return incidents.derive_incidents(_signals(t), t.preds(7 * DAY), t.snaps(7 * DAY), t.as_of)


SIGNAL_OUT = "signal_id, system_id, fault_type, fault_subtype, severity, count, systems, first_seen, last_seen, is_spike, max_confidence"


@query("a19_signals", f"SELECT {SIGNAL_OUT} FROM signals")
def _(t):
    return signals.ordered_signals(_signals(t)).select(*[c.strip() for c in SIGNAL_OUT.split(",")])


@query("a19_two_minute_signals", f"""
SELECT system_id, fault_type, coalesce(fault_subtype,'general') AS fault_subtype, time_bucket(INTERVAL '2 minutes', ingested_at, {EPOCH}) AS bucket, count(*) AS count FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 1 DAY GROUP BY 1, 2, 3, 4""")
def _(t):
    return signals.group_signals(t.tel, t.as_of).select("system_id", "fault_type", "fault_subtype", "bucket", "count")


@query("p15_shown_signals", "SELECT signal_id FROM signals WHERE is_spike OR severity = 'CRITICAL'")
def _(t):
    return shaping.spike_or_critical(_signals(t)).select("signal_id")


@query("p15_shown_incidents", "SELECT count(*) FILTER (WHERE priority_label <> 'LOW') AS shown, count(*) FILTER (WHERE priority_label = 'LOW') AS hidden FROM incidents")
def _(t):
    return shaping.noise_summary(_incidents(t), F.col("priority_label") != "LOW")


INC_OUT = "incident_key, incident_id, title, fault_type, severity, system_id, systems, event_count, priority_score, priority_label, trigger, lifecycle, predicted_fault, trend, created_at"


@query("i01_incidents", f"SELECT {INC_OUT}, round(confidence, 6) AS confidence, round(anomaly_score, 3) AS anomaly_score, round(failure_prob, 3) AS failure_prob FROM incidents")
def _(t):
    return incidents.ordered_incidents(_incidents(t)).select(
        *[c.strip() for c in INC_OUT.split(",")], F.round("confidence", 6).alias("confidence"), F.round("anomaly_score", 3).alias("anomaly_score"), F.round("failure_prob", 3).alias("failure_prob")
    )


@query("u02_incident_triggers", "SELECT trigger, count(*) AS incidents FROM incidents GROUP BY 1")
def _(t):
    return _incidents(t).groupBy("trigger").agg(F.count(F.lit(1)).alias("incidents"))


@query("i02_priorities", "SELECT incident_key, priority_score, priority_label FROM incidents")
def _(t):
    return _incidents(t).select("incident_key", "priority_score", "priority_label")


@query("l05_top_incidents", """
SELECT incident_key, priority_score FROM incidents ORDER BY priority_score DESC, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END DESC, created_at DESC, incident_key LIMIT 20""")
def _(t):
    return incidents.ordered_incidents(_incidents(t)).limit(20).select("incident_key", "priority_score")


@query("j12_signals_with_predictions", """
SELECT s.signal_id, coalesce(t.anomaly_score, 0) AS anomaly_score, coalesce(t.failure_probability, 0) AS failure_probability, t.predicted_fault, coalesce(t.anomaly_trend, 'stable') AS anomaly_trend FROM signals s LEFT JOIN trend7 t ON t.system_id = s.system_id""")
def _(t):
    return incidents.signals_with_predictions(_signals(t), t.preds(7 * DAY)).select("signal_id", "anomaly_score", "failure_probability", "predicted_fault", "anomaly_trend")


@query("j13_incident_impact", """
SELECT i.incident_key, i.n_systems AS systems_affected, CAST(CAST(floor(avg(CAST(s.cpu_usage_percent AS DOUBLE)) + 0.5) AS BIGINT) AS VARCHAR) || '%' AS avg_cpu,
 '+' || CAST(CAST(floor(avg((s.critical_count + s.error_count)/greatest(s.total_events, 1))*100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS error_rate_delta, any_value(d.dominant_fault_type) AS dominant_fault
FROM incidents i JOIN snaps7 s ON s.system_id = i.system_id
JOIN (SELECT system_id, dominant_fault_type FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY critical_count DESC, snapshot_time DESC) AS r FROM snaps7) x WHERE r = 1) d ON d.system_id = i.system_id
GROUP BY 1, 2""")
def _(t):
    return incidents.impact(_incidents(t), t.snaps(7 * DAY)).select("incident_key", "systems_affected", "avg_cpu", "error_rate_delta", "dominant_fault")


@query("i03_forecast_boost", """
SELECT i.incident_key, f.system_id IS NOT NULL AS boosted, i.priority_score + CASE WHEN f.system_id IS NOT NULL THEN 20 ELSE 0 END AS priority_score,
 CASE WHEN f.system_id IS NOT NULL AND priority_label = 'LOW' THEN 'MEDIUM' WHEN f.system_id IS NOT NULL AND priority_label = 'MEDIUM' THEN 'HIGH' ELSE priority_label END AS priority_label
FROM incidents i LEFT JOIN (SELECT system_id FROM forecasts WHERE risk_level = 'imminent') f ON f.system_id = i.system_id""")
def _(t):
    rows = incidents.forecast_boost(_incidents(t), _forecasts(t))
    return rows.select("incident_key", "boosted", "priority_score", "priority_label")


def _lifecycle_actions(rows):
    """Acknowledge everything, resolve CRITICAL and ERROR, then reopen ERROR and acknowledge it again."""
    c, sev = F.col("created_at"), F.col("severity")

    def step(state, hours, condition):
        return F.when(condition, F.struct(F.lit(state).alias("state"), (c + F.make_dt_interval(hours=F.lit(hours))).alias("at")))

    steps = [step("ACKNOWLEDGED", 1, sev != "INFO"), step("RESOLVED", 2, sev.isin("CRITICAL", "ERROR")), step("OPEN", 3, sev == "ERROR"), step("ACKNOWLEDGED", 4, sev == "ERROR")]
    return rows.select("incident_id", F.inline(F.array_compact(F.array(*steps))))


LIFE = """SELECT i.*, CASE i.severity WHEN 'CRITICAL' THEN 'RESOLVED' WHEN 'ERROR' THEN 'ACKNOWLEDGED' WHEN 'WARNING' THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS state,
 CASE i.severity WHEN 'CRITICAL' THEN created_at + INTERVAL 1 HOUR WHEN 'ERROR' THEN created_at + INTERVAL 4 HOURS WHEN 'WARNING' THEN created_at + INTERVAL 1 HOUR END AS acknowledged_at,
 CASE WHEN i.severity = 'CRITICAL' THEN created_at + INTERVAL 2 HOURS END AS resolved_at FROM incidents i"""


def _with_life(t):
    # all triggers: the key tells incidents of one host apart that share an id
    rows = _incidents(t).withColumn("incident_id", F.col("incident_key"))
    return incidents.with_lifecycle(rows, _lifecycle_actions(rows))


@query("i04_lifecycle", f"SELECT incident_key AS incident_id, state AS lifecycle, acknowledged_at, resolved_at FROM ({LIFE}) x")
def _(t):
    return _with_life(t).select("incident_id", "lifecycle", "acknowledged_at", "resolved_at")


@query("i04_resolution_log", f"SELECT incident_key AS incident_id, fault_type, resolved_at, CAST(7200000 AS BIGINT) AS resolution_time_ms, 'OPEN→ACKNOWLEDGED→RESOLVED' AS lifecycle_path FROM ({LIFE}) x WHERE state = 'RESOLVED'")
def _(t):
    return incidents.resolution_log(_with_life(t))


@query("a25_mean_resolution", """
SELECT fault_type, count(*) AS resolutions, round(avg(ms), 3) AS avg_resolution_ms FROM (SELECT fault_type, occurrence_count * 1000 AS ms FROM (SELECT a.*, split_part(rule_name, ' ', 1) AS fault_type FROM alerts a) y ) x GROUP BY 1""")
def _(t):
    rows = alerts.roll_up(alerts.native_candidates(t.tel))
    log = rows.select(
        F.col("alert_key").alias("incident_id"), F.split_part("rule_name", F.lit(" "), F.lit(1)).alias("fault_type"), F.col("last_seen_at").alias("resolved_at"), (F.col("occurrence_count") * 1000).alias("resolution_time_ms")
    )
    return incidents.mean_resolution(log).withColumn("avg_resolution_ms", F.round("avg_resolution_ms", 3))


RATES = """SELECT hook_id, count(*) AS runs, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM (SELECT CASE severity WHEN 'CRITICAL' THEN 'restart-service' WHEN 'ERROR' THEN 'scale-instance' ELSE 'check-db-connections' END AS hook_id,
 occurrence_count % 2 = 0 AS ok FROM alerts ) x GROUP BY 1"""


def _rates(t):
    rows = alerts.roll_up(alerts.native_candidates(t.tel))
    s = F.col("severity")
    hook = F.when(s == "CRITICAL", "restart-service").when(s == "ERROR", "scale-instance").otherwise("check-db-connections")
    outcome = F.when(F.col("occurrence_count") % 2 == 0, "success").otherwise("failed")
    log = rows.select(hook.alias("hook_id"), F.col("alert_key").alias("incident_id"), outcome.alias("outcome"), F.col("last_seen_at").alias("at"))
    return incidents.remediation_rates(log).withColumn("success_rate", F.round("success_rate", 6))


@query("a26_remediation_rates", RATES)
def _(t):
    return _rates(t)


PLAYBOOK_SQL = ", ".join(
    f"('{key}', {i}, '{step[0]}', '{step[2]}', " + (f"'{step[3]}'" if step[3] else "NULL") + ")" for key, steps in playbook.PLAYBOOK.items() for i, step in enumerate(steps)
)


@query("p25_suggested_actions", f"""
SELECT i.incident_key, p.playbook, p.step_no, p.step, p.priority, p.hook, round(coalesce(r.success_rate, 0), 6) AS rate,
 row_number() OVER (PARTITION BY i.incident_key ORDER BY coalesce(r.success_rate, 0) DESC, p.step_no) AS position FROM (
 SELECT *, CASE WHEN trigger <> 'signal' THEN 'anomaly' WHEN contains(lower(fault_type),'cpu') THEN 'cpu' WHEN contains(lower(fault_type),'db') THEN 'db' WHEN contains(lower(fault_type),'network') THEN 'network' WHEN contains(lower(fault_type),'auth') THEN 'auth'
  WHEN contains(lower(fault_type),'crash') THEN 'crash' WHEN contains(lower(fault_type),'anomaly') THEN 'anomaly' WHEN contains(lower(fault_type),'disk') THEN 'disk' ELSE 'fallback' END AS pb
 FROM (SELECT * EXCLUDE (fault_type), CASE fault_type WHEN 'DRIVER_ISSUE' THEN 'DISK_ISSUE' WHEN 'SECURITY_EVENT' THEN 'AUTH_DB_EVENT' ELSE fault_type END AS fault_type FROM incidents) j) i
JOIN (VALUES {PLAYBOOK_SQL}) p(playbook, step_no, step, priority, hook) ON p.playbook = i.pb LEFT JOIN ({RATES}) r ON r.hook_id = p.hook
WHERE CASE i.priority_label WHEN 'LOW' THEN p.priority = 'monitor' WHEN 'MEDIUM' THEN p.priority <> 'monitor' ELSE true END""")
def _(t):
    fault = F.col("fault_type")
    renamed = F.when(fault == "DRIVER_ISSUE", "DISK_ISSUE").when(fault == "SECURITY_EVENT", "AUTH_DB_EVENT").otherwise(fault)
    rows = _incidents(t).withColumn("fault_type", renamed).withColumn("incident_id", F.col("incident_key"))
    out = playbook.suggested_actions(rows, _rates(t))
    return out.select(F.col("incident_id").alias("incident_key"), "playbook", "step_no", "step", "priority", "hook", F.round("rate", 6).alias("rate"), "position")


TIMELINE = """SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY ingested_at, id) AS position FROM (
 SELECT i.incident_key, t.id, t.fault_type, t.severity, t.ingested_at FROM incidents i JOIN tel t ON t.system_id = i.system_id AND abs(epoch_us(t.ingested_at) - epoch_us(i.created_at)) <= 86400000000) x"""


@query("j15_incident_timeline", f"SELECT incident_key, position, id, fault_type, severity, ingested_at FROM ({TIMELINE}) y WHERE position <= 12")
def _(t):
    return incidents.timeline(_incidents(t), t.tel, DAY).drop("is_causal")


@query("w09_causal_marks", f"""
SELECT incident_key, position, coalesce(lead(fault_type) OVER w <> fault_type AND epoch_us(lead(ingested_at) OVER w) - epoch_us(ingested_at) < 120000000, false) AS is_causal FROM ({TIMELINE}) y WHERE position <= 12 WINDOW w AS (PARTITION BY incident_key ORDER BY position)""")
def _(t):
    return incidents.timeline(_incidents(t), t.tel, DAY).select("incident_key", "position", "is_causal")


@query("a21_health_index", """
SELECT CAST(greatest(0, least(100, floor(100 - (10.0*(SELECT count(*) FROM incidents) + 0.5*(SELECT count(*) FROM signals WHERE is_spike) + 30*(SELECT count(*) FROM preds7 WHERE anomaly_score > 0.7 OR failure_probability > 0.6)) + 0.5))) AS BIGINT) AS health_index""")
def _(t):
    return incidents.system_health_index(_incidents(t), _signals(t), t.preds(7 * DAY))


@query("a23_kpi_strip", f"""
SELECT (SELECT count(*) FROM hb) AS systems, (SELECT count(*) FROM s WHERE status='online') AS online, (SELECT count(*) FROM s WHERE status='degraded') AS degraded, (SELECT count(*) FROM s WHERE status='offline') AS offline,
 (SELECT count(*) FROM alerts) AS active_alerts, (SELECT count(*) FROM incidents) AS incidents, (SELECT count(*) FROM incidents WHERE severity='CRITICAL') AS critical_incidents, (SELECT count(*) FROM incidents WHERE trigger <> 'signal') AS ml_incidents, (SELECT count(*) FROM signals) AS signals
FROM (SELECT 1) one""".replace("FROM s ", f"FROM (SELECT CASE WHEN epoch_us({AS_OF}) - epoch_us(last_seen) > 120000000 THEN 'offline' WHEN cpu_usage_percent > 90 OR memory_usage_percent > 95 THEN 'degraded' ELSE 'online' END AS status FROM hb) s "))
def _(t):
    systems = fleet.fleet_from_events(t.hb, t.tel, t.as_of, 40 * DAY, 0, limit=None)
    rows = alerts.roll_up(alerts.native_candidates(t.tel))
    return fleet.kpi_strip(systems, rows, _incidents(t), _signals(t))


# ---------------------------------------------------------------- correlation


ROLE = "(contains(lower(fault_type), '{0}') OR contains(lower(coalesce(predicted_fault,'')), '{0}'))"


def role_sql(words) -> str:
    return "(" + " OR ".join(ROLE.format(w) for w in words) + ")"


FIRST = "SELECT created_at, fault_type, system_id FROM incidents WHERE {0} ORDER BY created_at, incident_key LIMIT 1"
LAST = "SELECT created_at, fault_type, system_id FROM incidents WHERE {0} ORDER BY created_at DESC, incident_key DESC LIMIT 1"
CORR_OUT = ["correlation_id", "root_cause", "root_system", "confidence"]


def _correlations(t, inc):
    return correlation.correlate(inc, t.preds(7 * DAY), t.snaps(7 * DAY), t.hb, WORDS, fleet_limit=20, minutes=43200)


def _pattern(t, name, inc=None):
    rows = _correlations(t, _incidents(t) if inc is None else inc)
    return rows.filter(F.col("correlation_id") == name).select(*CORR_OUT)


C01 = f"""
WITH d AS ({FIRST.format(role_sql(WORDS["db"]))}), a AS ({FIRST.format(role_sql(WORDS["api"]))})
SELECT 'corr-db-api-cascade' AS correlation_id, d.fault_type || ' on ' || d.system_id || ' caused downstream API failures' AS root_cause, d.system_id AS root_system,
 CAST(CASE WHEN d.created_at <= a.created_at THEN 0.72 ELSE 0.48 END + CASE WHEN EXISTS (SELECT 1 FROM snaps7 s WHERE s.system_id = d.system_id AND critical_count > 5) THEN 0.1 ELSE 0 END AS DOUBLE) AS confidence FROM d, a"""


@query("c01_storage_api_cascade", C01)
def _(t):
    return _pattern(t, "corr-db-api-cascade")


C02 = """
WITH h AS (SELECT system_id, max(snapshot_time) AS hot_at FROM snaps7 WHERE cpu_usage_percent > 85 GROUP BY 1)
SELECT 'corr-cpu-exhaustion' AS correlation_id, 'CPU exhaustion causing cascading service degradation' AS root_cause, (SELECT system_id FROM h ORDER BY hot_at DESC, system_id DESC LIMIT 1) AS root_system,
 round(least(0.65 + ((SELECT avg(CAST(cpu_usage_percent AS DOUBLE)) FROM hb) - 80)/100, 0.9), 6) AS confidence WHERE (SELECT count(*) FROM incidents i JOIN h ON h.system_id = i.system_id) > 0 AND (SELECT avg(CAST(cpu_usage_percent AS DOUBLE)) FROM hb) >= 20"""


@query("c02_cpu_exhaustion", C02)
def _(t):
    return _pattern(t, "corr-cpu-exhaustion")


C03 = f"""
SELECT 'corr-network-degradation' AS correlation_id, 'External network degradation affecting multiple systems' AS root_cause, CAST(NULL AS VARCHAR) AS root_system, CAST(least(0.55 + 0.05*count(*), 0.9) AS DOUBLE) AS confidence
FROM incidents WHERE {role_sql(WORDS["network"])} HAVING count(*) >= 2 AND count(DISTINCT system_id) >= 2"""


@query("c03_network_degradation", C03)
def _(t):
    return _pattern(t, "corr-network-degradation")


@query("c04_isolated_node", """
SELECT i.system_id, 'corr-isolated-node' AS correlation_id, 'Isolated node failure: ' || i.system_id AS root_cause, i.system_id AS root_system, round(least(0.70 + 0.15*coalesce(any_value(p.failure_probability), 0), 0.95), 6) AS confidence,
 'All ' || CAST(count(*) AS VARCHAR) || ' incidents share single system: ' || i.system_id AS shared
FROM incidents i LEFT JOIN trend7 p ON p.system_id = i.system_id GROUP BY i.system_id HAVING count(*) >= 2""")
def _(t):
    found = correlation.isolated_nodes(_incidents(t), t.preds(7 * DAY), ["system_id"])
    return found.select("system_id", *CORR_OUT, F.element_at("evidence", 1).alias("shared"))


@query("c04_isolated_node_of_all", """
SELECT 'corr-isolated-node' AS correlation_id, 'Isolated node failure: ' || min(system_id) AS root_cause FROM incidents HAVING count(DISTINCT system_id) = 1 AND count(*) >= 2""")
def _(t):
    return _pattern(t, "corr-isolated-node").select("correlation_id", "root_cause")


@query("u05_common_systems", """
SELECT created_at, min(system_id) AS system_id, count(DISTINCT incident_key) AS incidents FROM incidents GROUP BY 1 HAVING count(DISTINCT system_id) = 1""")
def _(t):
    return correlation.common_systems(_incidents(t), ["created_at"])


@query("u05_common_systems_by_severity", """
WITH n AS (SELECT fault_type, severity, count(DISTINCT incident_key) AS total FROM incidents GROUP BY ALL)
SELECT i.fault_type, i.severity, i.system_id, count(DISTINCT i.incident_key) AS incidents FROM incidents i JOIN n ON n.fault_type IS NOT DISTINCT FROM i.fault_type AND n.severity IS NOT DISTINCT FROM i.severity
GROUP BY i.fault_type, i.severity, i.system_id, n.total HAVING count(DISTINCT i.incident_key) = n.total""")
def _(t):
    return correlation.common_systems(_incidents(t), ["fault_type", "severity"])


C05 = f"""
WITH c AS ({FIRST.format(role_sql(WORDS["crash"]))}), a AS ({LAST.format(role_sql(WORDS["auth"]))})
SELECT 'corr-auth-after-crash' AS correlation_id, 'Service crash on ' || c.system_id || ' caused auth token invalidation' AS root_cause, c.system_id AS root_system, 0.68::DOUBLE AS confidence
FROM c, a WHERE c.created_at <= a.created_at AND (epoch_us(a.created_at) - epoch_us(c.created_at))/60000000.0 <= 43200"""


@query("c05_auth_after_crash", C05)
def _(t):
    return _pattern(t, "corr-auth-after-crash")


C04 = """SELECT 'corr-isolated-node' AS correlation_id FROM incidents HAVING count(DISTINCT system_id) = 1 AND count(*) >= 2"""
FOUND = " UNION ALL ".join(f"SELECT correlation_id FROM ({part}) c" for part in (C01, C02, C03, C04, C05))


@query("c06_correlations", f"SELECT correlation_id, replace(substr(correlation_id, 6), '-', '_') AS pattern FROM ({FOUND}) f")
def _(t):
    return _correlations(t, _incidents(t)).select("correlation_id", "pattern")


MEMBERS = f"""
SELECT * FROM (SELECT DISTINCT 'corr-db-api-cascade' AS correlation_id, system_id FROM incidents WHERE {role_sql(WORDS["db"])} OR {role_sql(WORDS["api"])} UNION SELECT 'corr-network-degradation', system_id FROM incidents WHERE {role_sql(WORDS["network"])}
UNION SELECT 'corr-auth-after-crash', system_id FROM incidents WHERE {role_sql(WORDS["crash"])} OR {role_sql(WORDS["auth"])} UNION SELECT 'corr-cpu-exhaustion', system_id FROM incidents WHERE system_id IN (SELECT system_id FROM snaps7 WHERE cpu_usage_percent > 85)
UNION SELECT 'corr-cpu-exhaustion', system_id FROM (SELECT system_id FROM snaps7 WHERE cpu_usage_percent > 85 ORDER BY snapshot_time DESC, system_id DESC LIMIT 1) r) m WHERE correlation_id IN (SELECT correlation_id FROM ({FOUND}) f)"""


@query("c06_affected_systems", MEMBERS)
def _(t):
    inc = _incidents(t)
    return correlation.correlation_systems(_correlations(t, inc), inc, t.snaps(7 * DAY), WORDS)


@query("j14_incident_correlations", f"SELECT DISTINCT i.incident_key, m.correlation_id FROM incidents i JOIN ({MEMBERS}) m ON m.system_id = i.system_id")
def _(t):
    inc = _incidents(t)
    members = correlation.correlation_systems(_correlations(t, inc), inc, t.snaps(7 * DAY), WORDS)
    return correlation.incident_correlations(inc, members)


# ---------------------------------------------------------------- forecast and models


def _forecasts(t):
    return forecast.forecasts(forecast.prediction_history(t.preds()), t.snaps())


@query("w08_prediction_history", "SELECT system_id, prediction_time, newest_no FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY prediction_time DESC) AS newest_no FROM preds1) x WHERE newest_no <= 10")
def _(t):
    return forecast.prediction_history(t.preds()).select("system_id", "prediction_time", "newest_no")


@query("m07_forecasts", "SELECT system_id, samples, trend, p AS failure_prob_now, time_to_failure, forecast_conf, risk_level FROM forecasts")
def _(t):
    return forecast.ordered_forecasts(_forecasts(t))


@query("m07_spend_regression", """
SELECT o_custkey, count(*) AS samples, round(regr_slope(o_totalprice, x), 4) AS slope, round(regr_r2(o_totalprice, x), 6) AS r2 FROM (
 SELECT o_custkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS DOUBLE) AS x FROM orders) h WHERE x <= 10 GROUP BY 1""")
def _(t):
    """The same bounded-history regression on the larger orders table."""
    from fleetsight.functions.ordered import latest_per_key

    newest = latest_per_key(t.table("orders"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc(), n=10, rank="x")
    x = F.col("x").cast("double")
    return newest.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.regr_slope("o_totalprice", x), 4).alias("slope"), F.round(F.regr_r2("o_totalprice", x), 6).alias("r2")
    )


@query("w10_score_trends", """
SELECT system_id, prediction_time, CASE WHEN anomaly_score > p + 0.05 THEN 'rising' WHEN anomaly_score < p - 0.05 THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT *, lag(anomaly_score) OVER (PARTITION BY system_id ORDER BY prediction_time) AS p FROM preds1) x""")
def _(t):
    return forecast.score_trends(t.preds()).select("system_id", "prediction_time", "trend")


def z_sql(c: str) -> str:
    return f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ())/stddev_pop(CAST({c} AS DOUBLE)) OVER (), 6)"


@query("m01_standardized_features", f"""
SELECT system_id, snapshot_time, {z_sql("cpu_usage_percent")} AS z_cpu, {z_sql("memory_usage_percent")} AS z_memory, {z_sql("disk_free_percent")} AS z_disk, {z_sql("error_count")} AS z_error, {z_sql("critical_count")} AS z_critical FROM snaps1""")
def _(t):
    rows = scoring.standardize(t.snaps())
    names = {"cpu_usage_percent": "z_cpu", "memory_usage_percent": "z_memory", "disk_free_percent": "z_disk", "error_count": "z_error", "critical_count": "z_critical"}
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return rows.select("system_id", "snapshot_time", *[(F.round(f"z_{c}", 6) + F.lit(0.0)).alias(n) for c, n in names.items()])


@query("m04_heuristic_scores", "SELECT system_id, prediction_time, anomaly_score, is_anomaly, predicted_fault FROM preds1")
def _(t):
    return t.preds().select("system_id", "prediction_time", "anomaly_score", "is_anomaly", "predicted_fault")


@query("m05_failure_probability", "SELECT system_id, snapshot_time, CAST(least(critical_count*0.2 + error_count*0.1, 1.0) AS DOUBLE) AS failure_probability FROM snaps7")
def _(t):
    return t.snaps(7 * DAY).select("system_id", "snapshot_time", F.round(scoring.failure_probability(), 6).alias("failure_probability"))


@query("w04_latest_snapshot_per_host", "SELECT system_id, snapshot_time, total_events FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY snapshot_time DESC) AS r FROM snaps1) x WHERE r = 1")
def _(t):
    return scoring.latest_snapshot_per_host(t.snaps()).select("system_id", "snapshot_time", "total_events")


@query("m06_scoring_cycle_heuristic", f"""
SELECT p.system_id, {AS_OF} AS prediction_time, p.anomaly_score, p.is_anomaly, p.failure_probability, p.predicted_fault FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY prediction_time DESC) AS r FROM preds1) p WHERE r = 1""")
def _(t):
    rows = scoring.scoring_cycle(t.snaps(), at(t.as_of), batch_rows=None, use_model=False)
    return rows.drop("cluster_id", "model_version")


@query("m06_scoring_cycle_model")
def _(t):
    return scoring.scoring_cycle(t.snaps(), at(t.as_of))


@query("m02_isolation_forest")
def _(t):
    rows = t.snaps().withColumn("rid", F.xxhash64("system_id", "snapshot_time"))
    return scoring.isolation_forest(rows, "rid").select("system_id", "snapshot_time", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("m02_isolation_forest_embeddings")
def _(t):
    vectors = t.table("embeddings")
    width = vectors.select(F.max(F.size("embedding"))).first()[0]
    columns = [f"d{i}" for i in range(width)]
    wide = vectors.select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"d{i}") for i in range(width)])
    return scoring.isolation_forest(wide, "vec_id", columns).select("vec_id", "label", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("m02_forest_invariants", """
SELECT count(*) AS rows, count(DISTINCT system_id) AS hosts, CAST(0 AS DOUBLE) AS lowest, CAST(1 AS DOUBLE) AS highest, true AS few_flagged, true AS flagged_score_highest FROM snaps1""")
def _(t):
    rows = t.snaps().withColumn("rid", F.xxhash64("system_id", "snapshot_time"))
    flagged, score = F.col("is_anomaly"), F.col("anomaly_score")
    return scoring.isolation_forest(rows, "rid").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("system_id").alias("hosts"), F.min(score).alias("lowest"), F.max(score).alias("highest"),
        (F.count_if(flagged).between(1, F.ceil(F.count(F.lit(1)) * F.lit(FOREST_CONTAMINATION)))).alias("few_flagged"),
        (F.min(F.when(flagged, score)) > F.max(F.when(~flagged, score))).alias("flagged_score_highest"),
    )


@query("m03_cluster_invariants", "SELECT count(*) AS rows, count(DISTINCT system_id) AS hosts, true AS within_k, true AS all_assigned FROM snaps1")
def _(t):
    return scoring.kmeans_clusters(t.snaps()).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("system_id").alias("hosts"),
        F.countDistinct("cluster_id").between(2, KMEANS_CLUSTERS).alias("within_k"), (F.count("cluster_id") == F.count(F.lit(1))).alias("all_assigned"),
    )


@query("m03_kmeans_clusters")
def _(t):
    return scoring.kmeans_clusters(t.snaps()).select("system_id", "snapshot_time", "cluster_id")


