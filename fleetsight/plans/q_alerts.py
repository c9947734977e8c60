"""Rule and alert queries (P-4, P-7 .. P-9, P-13, J-6, J-7, J-11, J-18, A-12, A-NAT .. A-ESC, D-*, U-1, W-5, L-1, L-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions.ordered import latest_per_key
from fleetsight.operators import adaptive, alerts, rules, shaping
from fleetsight.plans.registry import query
from fleetsight.sources.adapter import DAY

AS_OF = "(SELECT as_of FROM clk)"
HALF_DAY = 12 * 3600
KEEP = ["id", "system_id", "hostname", "severity", "fault_type", "ingested_at"]


def _events(t):
    return t.tel.withColumn("normalized_message", F.lower("event_message"))


def _matches(t):
    return rules.match_rules(_events(t), t.rules, KEEP)


@query("p07_parsed_rules", """
SELECT t.fault_type, p.id AS rule_id, p.field, p.op, p.expected, count(*) AS candidates FROM parsed p CROSS JOIN tel t GROUP BY ALL""")
def _(t):
    parsed = rules.parse_rules(t.rules.filter("enabled")).select(F.col("id").alias("rule_id"), "field", "op", "expected")
    faults = t.tel.groupBy("fault_type").agg(F.count(F.lit(1)).alias("candidates"))
    listed = parsed.agg(F.collect_list(F.struct("rule_id", "field", "op", "expected")).alias("rs"))
    # The parsed rules are a handful of rows; as one array value they go to every fault without a join.
    return faults.select("*", F.inline(listed.select("rs").scalar()))


@query("p07_fixed_double_equals", """
SELECT rule_id, id FROM matched WHERE rule_id <> 6 UNION ALL SELECT 6 AS rule_id, id FROM tel WHERE CAST(cpu_usage_percent AS DOUBLE) = 50""")
def _(t):
    return rules.match_rules(_events(t), t.rules, ["id"], fix_double_equals=True).select("rule_id", "id")


@query("p08_context_values", """
SELECT id, lower(event_message) AS message, CAST(CAST(cpu_usage_percent AS DOUBLE) AS VARCHAR) AS cpu, json_extract_string(diagnostic_context, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM tel""")
def _(t):
    e = _events(t)
    return e.select(
        "id",
        rules.context_value(e, "normalized_message").alias("message"),
        rules.context_value(e, "cpu_usage_percent").alias("cpu"),
        rules.context_value(e, "k").alias("k"),
        rules.context_value(e, "absent").alias("absent"),
    )


@query("p09_rule_predicate", """
SELECT id, CAST(cpu_usage_percent AS DOUBLE) > 42.5 AS above, CAST(cpu_usage_percent AS DOUBLE) <> 10 AS other, lower(severity) = 'error' AS is_error, lower(fault_type) >= 'service' AS sorted_after, contains(lower(event_message), 'view') AS viewed FROM tel""")
def _(t):
    cpu = F.col("cpu_usage_percent").cast("double").cast("string")

    def holds(actual, op, expected):
        return rules.condition_holds(actual, F.lit(op), F.lit(expected))

    return t.tel.select(
        "id",
        holds(cpu, ">", "42.5").alias("above"),
        holds(cpu, "!=", "10").alias("other"),
        holds(F.col("severity"), "==", "Error").alias("is_error"),
        holds(F.col("fault_type"), ">=", "Service").alias("sorted_after"),
        holds(F.col("event_message"), "contains", "VIEW").alias("viewed"),
    )


@query("j06_rule_matches", "SELECT rule_id, id, system_id FROM matched")
def _(t):
    return _matches(t).select("rule_id", "id", "system_id")


@query("j06_match_counts", "SELECT rule_id, count(*) AS matches FROM matched GROUP BY 1")
def _(t):
    return _matches(t).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))


@query("j07_recent_matches", "SELECT rule_id, id, recent FROM fired")
def _(t):
    return rules.firing_matches(_matches(t), HALF_DAY).select("rule_id", "id", "recent")


CAND = "alert_key, source_type, rule_id, rule_name, system_id, hostname, severity, title, description, escalation_target, metadata, source_event_id, seen_at"


@query("a_nat_native_candidates", f"SELECT {CAND} FROM native_cand")
def _(t):
    return alerts.native_candidates(t.tel)


@query("a_rul_rule_candidates", f"SELECT {CAND} FROM rule_cand")
def _(t):
    return alerts.rule_candidates(_events(t), t.rules, HALF_DAY)


@query("u01_all_candidates", "SELECT source_type, severity, count(*) AS n, count(DISTINCT alert_key) AS keys FROM all_cand GROUP BY 1, 2")
def _(t):
    rows = alerts.alert_candidates(_events(t), t.rules, HALF_DAY)
    return rows.groupBy("source_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("alert_key").alias("keys"))


@query("a_ups_rolled_up_alerts", """
SELECT alert_key, source_type, rule_id, rule_name, system_id, severity, title, description, metadata, source_event_id, hostname, occurrence_count, first_seen_at, last_seen_at FROM alerts""")
def _(t):
    return alerts.roll_up(alerts.native_candidates(t.tel)).drop("escalation_target", "acknowledged")


@query("a_ups_all_sources", """
SELECT alert_key, count(*) AS occurrence_count, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, arg_max(source_event_id, source_event_id) AS source_event_id FROM all_cand GROUP BY 1""")
def _(t):
    rows = alerts.roll_up(alerts.alert_candidates(_events(t), t.rules, HALF_DAY))
    return rows.select("alert_key", "occurrence_count", "first_seen_at", "last_seen_at", "source_event_id")


def acknowledgements(candidates):
    born = candidates.groupBy("alert_key").agg(F.min("seen_at").alias("born"), F.min("severity").alias("severity"))
    first = born.select("alert_key", (F.col("born") + F.expr("INTERVAL 5 DAYS")).alias("acked_at"), F.lit(4320).alias("cooldown_minutes"))
    second = born.filter("severity = 'WARNING'").select(
        "alert_key", (F.col("born") + F.expr("INTERVAL 12 DAYS")).alias("acked_at"), F.lit(4320).alias("cooldown_minutes")
    )
    return first.unionByName(second)


def _acked_alerts(t):
    candidates = alerts.native_candidates(t.tel)
    return alerts.roll_up_with_acks(candidates, acknowledgements(candidates))


ALERT_OUT = "alert_key, episode, severity, title, description, hostname, source_event_id, occurrence_count, first_seen_at, last_seen_at, acknowledged, acknowledged_at, suppressed_until"


@query("a_ups_alerts_with_acks", f"SELECT {ALERT_OUT} FROM acked_alerts")
def _(t):
    return _acked_alerts(t).select(*[c.strip() for c in ALERT_OUT.split(",")])


@query("w05_newest_per_alert_key", """
SELECT alert_key, source_event_id, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY seen_at DESC, source_event_id DESC) AS r FROM native_cand) x WHERE r = 1""")
def _(t):
    rows = latest_per_key(alerts.native_candidates(t.tel), ["alert_key"], F.col("seen_at").desc(), F.col("source_event_id").desc())
    return rows.select("alert_key", "source_event_id", "seen_at")


BACKFILL = """
SELECT alert_key, source_event_id, hostname, title, seen_at AS last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY seen_at DESC, source_event_id DESC) AS r FROM (
 SELECT alert_key, source_event_id, label AS hostname, severity || ': ' || fault_type || ' on ' || label AS title, seen_at FROM (
  SELECT c.alert_key, c.source_event_id, c.seen_at, c.severity, t.fault_type, CASE WHEN t.hostname = '' THEN t.system_id ELSE t.hostname END AS label FROM native_cand c JOIN tel t ON t.id = c.source_event_id {limit}) y) z) x
WHERE r = 1 AND alert_key NOT IN (SELECT alert_key FROM acked_alerts WHERE NOT acknowledged)"""


@query("a_bf_native_backfill", BACKFILL.format(limit=""))
def _(t):
    return alerts.backfill_native(t.tel, _acked_alerts(t)).select("alert_key", "source_event_id", "hostname", "title", "last_seen_at")


@query("a_bf_native_backfill_all", BACKFILL.format(limit=""))
def _(t):
    rows = alerts.backfill_native(t.tel, _acked_alerts(t), limit=None)
    return rows.select("alert_key", "source_event_id", "hostname", "title", "last_seen_at")


@query("a12_rule_backfill", f"""
SELECT sha256('rule|' || CAST(rule_id AS VARCHAR) || '|' || system_id || '|' || arg_max(severity, ingested_at) || '|' || arg_max(fault_type, ingested_at)) AS alert_key, rule_id, system_id, count(*) AS occurrence_count,
 max(ingested_at) AS last_seen_at, rule_severity || ': ' || rule_name || ' on ' || CASE WHEN arg_max(hostname, ingested_at) = '' THEN system_id ELSE arg_max(hostname, ingested_at) END AS title,
 '{{"backfilled":true,"match_count":' || CAST(count(*) AS VARCHAR) || '}}' AS metadata
FROM matched WHERE ingested_at >= {AS_OF} - INTERVAL 10 DAYS GROUP BY rule_id, rule_name, rule_severity, threshold, system_id HAVING count(*) >= greatest(1, threshold)""".replace("{{", "{").replace("}}", "}"))
def _(t):
    rows = alerts.backfill_rules(_events(t), t.rules, t.as_of, lookback_seconds=10 * DAY, limit=None)
    return rows.select("alert_key", "rule_id", "system_id", "occurrence_count", "last_seen_at", "title", "metadata")


ACTIONS = f"""SELECT a.*, CASE WHEN severity = 'WARNING' THEN CAST(NULL AS BIGINT) ELSE source_event_id % 5 + 1 END AS rid, last_seen_at + INTERVAL 1 HOUR AS acted FROM alerts a"""


def _numbered(t):
    """Alerts with the id of their newest event as alert id and a rule reference for the severe ones."""
    rows = alerts.roll_up(alerts.native_candidates(t.tel))
    rule = F.when(F.col("severity") != "WARNING", F.col("source_event_id") % 5 + 1)
    return rows.withColumn("id", F.col("source_event_id")).withColumn("rule_id", rule)


def _actions(rows):
    """Two actions per critical alert (the later one counts) and a malformed one per error alert."""
    shaped = F.concat(F.when(F.col("severity") == "ERROR", "INC-").otherwise("ALERT-"), F.col("id").cast("string"))
    base = rows.filter(F.col("severity").isin("CRITICAL", "ERROR")).select(shaped.alias("alert_id"), F.col("last_seen_at"))
    early = base.select("alert_id", F.lit("ann").alias("user_id"), F.col("last_seen_at").alias("at"), F.lit("failed").alias("delivery_status"))
    late = base.select("alert_id", F.lit("bob").alias("user_id"), (F.col("last_seen_at") + F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit("delivered").alias("delivery_status"))
    return early.unionByName(late)


@query("a_ack_acknowledged_alerts", f"""
SELECT alert_key, severity = 'CRITICAL' AS acknowledged, CASE WHEN severity = 'CRITICAL' THEN acted END AS acknowledged_at,
 CASE WHEN severity = 'CRITICAL' THEN acted + (SELECT cooldown_minutes FROM rules r WHERE r.id = rid) * INTERVAL 1 MINUTE END AS suppressed_until,
 CASE WHEN severity = 'CRITICAL' THEN left(metadata, length(metadata) - 1) || ',"acknowledged_by":"bob"}}' ELSE metadata END AS metadata FROM ({ACTIONS}) x""".replace("}}", "}"))
def _(t):
    rows = _numbered(t)
    changed = alerts.acknowledge(rows, _actions(rows), t.rules)
    return changed.select("alert_key", "acknowledged", "acknowledged_at", "suppressed_until", "metadata")


@query("j11_acknowledged_events", f"SELECT source_event_id AS event_id, acted AS acknowledged_at FROM ({ACTIONS}) x WHERE severity = 'CRITICAL'")
def _(t):
    rows = _numbered(t)
    return alerts.acknowledged_events(rows, _actions(rows))


@query("a_esc_escalated_alerts", f"""
SELECT alert_key, severity = 'CRITICAL' AS escalated, CASE WHEN severity = 'CRITICAL' THEN acted END AS escalated_at, CASE WHEN severity = 'CRITICAL' THEN CASE WHEN rid = 5 THEN 'no_target' ELSE 'delivered' END END AS escalation_status,
 CASE WHEN rid IN (1,2,3,4) THEN 'team-' || CAST(rid AS VARCHAR) END AS escalation_target FROM ({ACTIONS}) x""")
def _(t):
    rows = _numbered(t)
    target = F.when(F.col("rule_id") < 5, F.concat(F.lit("team-"), F.col("rule_id").cast("string")))
    rows = rows.withColumn("escalation_target", target)
    changed = alerts.escalate(rows, _actions(rows))
    return changed.select("alert_key", "escalated", "escalated_at", "escalation_status", "escalation_target")


@query("a_ack_audit_rows", f"""
SELECT u.user_id, 'acknowledge_alert' AS action, CAST(source_event_id AS VARCHAR) AS resource_id, CASE WHEN u.user_id = 'bob' THEN acted ELSE last_seen_at END AS "at" FROM ({ACTIONS}) x CROSS JOIN (VALUES ('ann'),('bob')) u(user_id) WHERE severity = 'CRITICAL'""")
def _(t):
    return alerts.audit_rows(_actions(_numbered(t)), "acknowledge_alert")


@query("p04_shaped_alerts", """
SELECT 'ALERT-' || CAST(source_event_id AS VARCHAR) AS alert_id, system_id, CASE WHEN hostname = '' THEN system_id ELSE hostname END AS hostname, severity, rule_name AS rule, title, description, first_seen_at AS triggered_at, false AS acknowledged,
 occurrence_count, 'active' AS status FROM alerts""")
def _(t):
    rows = _numbered(t).withColumns({"acknowledged_at": F.lit(None).cast("timestamp"), "escalated": F.lit(False), "escalated_at": F.lit(None).cast("timestamp"), "assigned_to": F.lit(None).cast("string")})
    return shaping.shape_alert(rows).drop("acknowledged_at", "escalated", "escalated_at", "assigned_to", "acknowledged_by")


@query("l01_newest_alerts", "SELECT alert_key, last_seen_at FROM acked_alerts ORDER BY last_seen_at DESC, alert_key DESC LIMIT 200")
def _(t):
    return shaping.newest(_acked_alerts(t), "last_seen_at", 200, "alert_key").select("alert_key", "last_seen_at")


@query("l01_recent_active_alerts", "SELECT alert_key, last_seen_at FROM acked_alerts WHERE NOT acknowledged ORDER BY last_seen_at DESC, alert_key DESC LIMIT 10")
def _(t):
    return shaping.newest(_acked_alerts(t).filter(~F.col("acknowledged")), "last_seen_at", 10, "alert_key").select("alert_key", "last_seen_at")


@query("l04_sorted_alerts", "SELECT alert_key, severity FROM alerts")
def _(t):
    return shaping.sort_alerts(alerts.roll_up(alerts.native_candidates(t.tel)), "severity").select("alert_key", "severity")


@query("p13_dashboard_alerts", f"""
SELECT alert_key, episode, acknowledged FROM (SELECT alert_key, episode, acknowledged, last_seen_at FROM acked_alerts WHERE NOT acknowledged AND severity IN ('CRITICAL','WARNING') AND (contains(lower(rule_name),'error') OR contains(lower(title),'error') OR contains(lower(hostname),'error')) ) a
UNION ALL SELECT alert_key, episode, acknowledged FROM acked_alerts WHERE acknowledged AND first_seen_at >= {AS_OF} - INTERVAL 20 DAYS AND severity IN ('CRITICAL','WARNING') AND (contains(lower(rule_name),'error') OR contains(lower(title),'error') OR contains(lower(hostname),'error'))""")
def _(t):
    rows = shaping.dashboard_alerts(_acked_alerts(t), t.as_of, 20 * DAY, severities=["CRITICAL", "WARNING"], query="Error")
    return rows.select("alert_key", "episode", "acknowledged")


HISTORY = f"""SELECT rule_name || ' / ' || system_id AS rule, count(*) FILTER (WHERE seen_at > {AS_OF} - INTERVAL 5 DAYS) AS count, min(seen_at) FILTER (WHERE seen_at > {AS_OF} - INTERVAL 5 DAYS) AS first_seen, max(seen_at) AS last_seen
 FROM native_cand WHERE seen_at < {AS_OF} GROUP BY 1"""


def _rule_alerts(t):
    """Candidates with a rule name per host, which gives the history enough rules."""
    return alerts.native_candidates(t.tel).withColumn("rule_name", F.concat_ws(" / ", "rule_name", "system_id"))


def _history(t):
    return adaptive.rule_history(_rule_alerts(t), t.as_of, 5 * DAY)


@query("d01_rule_history", HISTORY)
def _(t):
    return _history(t)


RESOLUTION = "SELECT rule_name || ' / ' || system_id AS rule, avg(occurrence_count) * 60000.0 AS avg_resolution_ms FROM alerts WHERE severity <> 'ERROR' GROUP BY 1"


@query("d02_adaptive_severity", f"""
SELECT alert_key, severity, delta AS severity_delta, coalesce(count, 0) AS suppression_count, CASE delta WHEN 'boosted' THEN CASE severity WHEN 'WARNING' THEN 'ERROR' ELSE 'CRITICAL' END
 WHEN 'suppressed' THEN CASE severity WHEN 'CRITICAL' THEN 'ERROR' WHEN 'ERROR' THEN 'WARNING' ELSE 'INFO' END ELSE severity END AS adaptive_severity FROM (
 SELECT a.alert_key, a.severity, h.count, CASE WHEN h.rule IS NULL OR epoch_us({AS_OF}) - epoch_us(h.last_seen) > 3*86400000000 THEN 'boosted'
  WHEN h.count > 5 AND epoch_us({AS_OF}) - epoch_us(h.first_seen) < 5*86400000000 AND coalesce(r.avg_resolution_ms, 0) < 300000 THEN 'suppressed' ELSE 'nominal' END AS delta
 FROM alerts a LEFT JOIN ({HISTORY}) h ON h.rule = a.rule_name || ' / ' || a.system_id LEFT JOIN ({RESOLUTION}) r ON r.rule = a.rule_name || ' / ' || a.system_id) x""")
def _(t):
    rows = alerts.roll_up(alerts.native_candidates(t.tel)).withColumn("rule_name", F.concat_ws(" / ", "rule_name", "system_id"))
    slow = rows.filter("severity <> 'ERROR'").groupBy(F.col("rule_name").alias("rule")).agg((F.avg("occurrence_count") * 60000.0).alias("avg_resolution_ms"))
    out = adaptive.adaptive_severity(rows, _history(t), t.as_of, slow, noise_seconds=5 * DAY, rare_seconds=3 * DAY)
    return out.select("alert_key", "severity", "severity_delta", "suppression_count", "adaptive_severity")


@query("j18_alerts_with_stats", f"""
SELECT a.alert_key, h.count, h.last_seen, round(r.avg_resolution_ms, 3) AS avg_resolution_ms FROM alerts a LEFT JOIN ({HISTORY}) h ON h.rule = a.rule_name || ' / ' || a.system_id LEFT JOIN ({RESOLUTION}) r ON r.rule = a.rule_name || ' / ' || a.system_id""")
def _(t):
    rows = alerts.roll_up(alerts.native_candidates(t.tel)).withColumn("rule", F.concat_ws(" / ", "rule_name", "system_id"))
    slow = rows.filter("severity <> 'ERROR'").groupBy("rule").agg((F.avg("occurrence_count") * 60000.0).alias("avg_resolution_ms"))
    joined = rows.join(_history(t), "rule", "left").join(slow, "rule", "left")
    return joined.select("alert_key", "count", "last_seen", F.round("avg_resolution_ms", 3).alias("avg_resolution_ms"))


@query("d03_rolling_resolution", """
WITH RECURSIVE l AS (SELECT system_id AS rule, CAST(round(cpu_usage_percent * 100, 0) AS DOUBLE) * (CASE WHEN severity = 'CRITICAL' THEN 0 ELSE 1 END) AS x, row_number() OVER (PARTITION BY system_id ORDER BY ingested_at, id) AS n FROM tel),
 f AS (SELECT rule, n, x AS v FROM l WHERE n = 1 UNION ALL SELECT l.rule, l.n, CASE WHEN f.v = 0 THEN l.x ELSE (f.v + l.x)/2 END FROM f JOIN l ON l.rule = f.rule AND l.n = f.n + 1)
SELECT rule, round(arg_max(v, n), 4) AS avg_resolution_ms FROM f GROUP BY 1""")
def _(t):
    ms = F.when(F.col("severity") == "CRITICAL", 0.0).otherwise(F.round(F.col("cpu_usage_percent") * 100, 0).cast("double"))
    log = t.tel.select(F.col("system_id").alias("rule"), ms.alias("resolution_time_ms"), F.col("ingested_at").alias("resolved_at"), F.col("id").alias("incident_id"))
    return adaptive.rolling_resolution(log).select("rule", F.round("avg_resolution_ms", 4).alias("avg_resolution_ms"))
