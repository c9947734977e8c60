"""Shared CTEs of the oracle SQL (DuckDB)."""

from __future__ import annotations

import re

EPOCH = "TIMESTAMP '1970-01-01'"


def mean(x: str, digits: int) -> str:
    """Exact half-up mean of a decimal(.,2) column to ``digits`` digits."""
    k = 10 ** (2 - digits)
    return (
        f"CAST((2*sum(CAST({x}*100 AS BIGINT)) + {k}*count({x})) // (2*{k}*count({x})) AS DOUBLE) / {10 ** digits}"
    )


def _snaps(days: int) -> str:
    return f"""
  SELECT b.system_id, b.w AS snapshot_time, l.cpu_usage_percent, l.memory_usage_percent, l.disk_free_percent,
    b.total_events, b.critical_count, b.error_count, b.warning_count, b.info_count, d.fault_type AS dominant_fault_type,
    b.avg_confidence
  FROM (
    SELECT system_id, time_bucket(INTERVAL '{days} days', ingested_at, {EPOCH}) AS w, count(*) AS total_events,
      count(*) FILTER (WHERE severity='CRITICAL') AS critical_count, count(*) FILTER (WHERE severity='ERROR') AS error_count,
      count(*) FILTER (WHERE severity='WARNING') AS warning_count, count(*) FILTER (WHERE severity='INFO') AS info_count,
      {mean("coalesce(confidence_score, CAST(0.20 AS DECIMAL(3,2)))", 2)} AS avg_confidence
    FROM tel GROUP BY 1, 2) b
  JOIN (
    SELECT * FROM (SELECT *, time_bucket(INTERVAL '{days} days', ingested_at, {EPOCH}) AS w,
      row_number() OVER (PARTITION BY system_id, time_bucket(INTERVAL '{days} days', ingested_at, {EPOCH})
                         ORDER BY ingested_at DESC, id DESC) AS r FROM tel) x WHERE r = 1) l
    ON l.system_id = b.system_id AND l.w = b.w
  JOIN (
    SELECT * FROM (SELECT system_id, w, fault_type, row_number() OVER (PARTITION BY system_id, w ORDER BY n DESC, fault_type) AS r
      FROM (SELECT system_id, time_bucket(INTERVAL '{days} days', ingested_at, {EPOCH}) AS w, fault_type, count(*) AS n
            FROM tel GROUP BY 1, 2, 3) c) y WHERE r = 1) d
    ON d.system_id = b.system_id AND d.w = b.w"""


def _preds(snaps: str) -> str:
    return f"""
  SELECT system_id, snapshot_time AS prediction_time,
    CAST(least(CASE WHEN cpu_usage_percent>85 THEN 0.3 ELSE 0 END + CASE WHEN memory_usage_percent>90 THEN 0.3 ELSE 0 END
      + CASE WHEN critical_count>2 THEN 0.4 ELSE 0 END, 1.0) AS DOUBLE) AS anomaly_score,
    CASE WHEN cpu_usage_percent>85 THEN 0.3 ELSE 0 END + CASE WHEN memory_usage_percent>90 THEN 0.3 ELSE 0 END
      + CASE WHEN critical_count>2 THEN 0.4 ELSE 0 END >= 0.5 AS is_anomaly,
    CAST(least(critical_count*0.2 + error_count*0.1, 1.0) AS DOUBLE) AS failure_probability,
    CASE WHEN critical_count>3 THEN 'SYSTEM_FAILURE' WHEN error_count>5 THEN 'SERVICE_DEGRADATION' ELSE 'NONE' END AS predicted_fault,
    CAST(NULL AS BIGINT) AS cluster_id, 'v2-isof' AS model_version
  FROM {snaps}"""


VIEWS: dict[str, str] = {
    "clk": "SELECT max(ts) AS as_of FROM events",
    "tel": """
  SELECT event_id AS id, 'SYS-' || lpad(CAST(user_id AS VARCHAR),4,'0') AS system_id,
    CASE WHEN user_id % 10 = 0 THEN '' ELSE 'host-' || CAST(user_id % 40 AS VARCHAR) END AS hostname,
    'System' AS log_channel,
    CASE event_type WHEN 'error' THEN 'Service Control Manager' WHEN 'purchase' THEN 'Microsoft-Windows-Kernel-Processor-Power'
      WHEN 'signup' THEN 'Microsoft-Windows-DistributedCOM' WHEN 'view' THEN 'Netwtw14' ELSE 'App-Host' END AS provider_name,
    CASE event_type WHEN 'error' THEN 7031 WHEN 'purchase' THEN 37 WHEN 'signup' THEN 10016 WHEN 'view' THEN 5002 ELSE 1000 END AS event_code,
    CASE WHEN event_type='error' AND value>=20 THEN 'CRITICAL' WHEN event_type='error' THEN 'ERROR'
      WHEN event_type IN ('purchase','signup') THEN 'WARNING' ELSE 'INFO' END AS severity,
    CASE WHEN event_type='error' AND value>=20 THEN 1 WHEN event_type='error' THEN 2
      WHEN event_type IN ('purchase','signup') THEN 3 ELSE 4 END AS level,
    CASE event_type WHEN 'error' THEN 'SERVICE_ERROR' WHEN 'purchase' THEN 'RESOURCE_WARNING'
      WHEN 'signup' THEN 'SECURITY_EVENT' WHEN 'view' THEN 'DRIVER_ISSUE' ELSE 'UNKNOWN' END AS fault_type,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'sub' || CAST(event_id % 3 AS VARCHAR) END AS fault_subtype,
    CAST(least(value,100) AS DECIMAL(5,2)) AS cpu_usage_percent,
    CAST(CAST(regexp_extract(props,'([0-9]+)',1) AS INT) % 101 AS DECIMAL(5,2)) AS memory_usage_percent,
    CAST(100 - CAST(regexp_extract(props,'([0-9]+)',1) AS INT) % 101 AS DECIMAL(5,2)) AS disk_free_percent,
    CASE WHEN event_id % 7 = 0 THEN NULL
      ELSE CAST(CAST(event_id % 100 AS DECIMAL(5,2))/100 AS DECIMAL(3,2)) END AS confidence_score,
    props AS diagnostic_context, event_type || ' on user ' || CAST(user_id AS VARCHAR) AS event_message, ts AS ingested_at
  FROM events""",
    "hb": """
  SELECT system_id, hostname, cpu_usage_percent, memory_usage_percent, disk_free_percent, ingested_at AS last_seen
  FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ingested_at DESC, id DESC) AS r FROM tel WHERE hostname <> '') t
  WHERE r = 1""",
    "snaps1": _snaps(1),
    "snaps7": _snaps(7),
    "preds1": _preds("snaps1"),
    "preds7": _preds("snaps7"),
    "rules": """
  SELECT * FROM (VALUES (1,'High CPU','cpu > 90','CRITICAL',1,30,NULL,true), (2,'Low disk','disk <= 10','WARNING',2,60,'ops@example.org',true),
    (3,'Service errors','fault_type = SERVICE_ERROR','ERROR',3,30,NULL,true), (4,'Text','message contains purchase','WARNING',1,15,NULL,true),
    (5,'Diag key','k >= 95','ERROR',1,30,'noc@example.org',true), (6,'Double equals quirk','cpu == 50','ERROR',1,30,NULL,true),
    (7,'Malformed','cpu above 9','ERROR',1,30,NULL,true), (8,'Disabled','cpu > 1','ERROR',1,30,NULL,false)
  ) r(id, rule_name, condition, severity, threshold, cooldown_minutes, escalation_target, enabled)""",
    "parsed": r"""
  SELECT *, CASE lower(f) WHEN 'cpu' THEN 'cpu_usage_percent' WHEN 'cpu_usage' THEN 'cpu_usage_percent' WHEN 'memory' THEN 'memory_usage_percent'
      WHEN 'mem' THEN 'memory_usage_percent' WHEN 'disk' THEN 'disk_free_percent' WHEN 'disk_free' THEN 'disk_free_percent'
      WHEN 'message' THEN 'normalized_message' WHEN 'provider' THEN 'provider_name' ELSE lower(f) END AS field
  FROM (SELECT *, regexp_extract(condition, '^\s*([a-zA-Z0-9_\.]+)\s*(>=|<=|!=|=|==|>|<|contains)\s*(.+?)\s*$', 1) AS f,
      regexp_extract(condition, '^\s*([a-zA-Z0-9_\.]+)\s*(>=|<=|!=|=|==|>|<|contains)\s*(.+?)\s*$', 2) AS op,
      trim(regexp_extract(condition, '^\s*([a-zA-Z0-9_\.]+)\s*(>=|<=|!=|=|==|>|<|contains)\s*(.+?)\s*$', 3), '''"') AS expected
    FROM rules WHERE enabled) p WHERE op <> ''""",
    "valued": """
  SELECT t.*, p.id AS rule_id, p.rule_name, p.condition, p.severity AS rule_severity, p.threshold, p.escalation_target, p.op, p.expected,
    CASE p.field WHEN 'cpu_usage_percent' THEN CAST(CAST(t.cpu_usage_percent AS DOUBLE) AS VARCHAR)
      WHEN 'disk_free_percent' THEN CAST(CAST(t.disk_free_percent AS DOUBLE) AS VARCHAR)
      WHEN 'fault_type' THEN t.fault_type WHEN 'normalized_message' THEN lower(t.event_message)
      ELSE json_extract_string(t.diagnostic_context, '$.' || p.field) END AS actual
  FROM tel t CROSS JOIN parsed p""",
    "matched": """
  SELECT * FROM valued WHERE actual IS NOT NULL AND CASE
    WHEN op = 'contains' THEN contains(lower(actual), lower(expected))
    WHEN try_cast(actual AS DOUBLE) IS NOT NULL AND try_cast(expected AS DOUBLE) IS NOT NULL THEN CASE op
      WHEN '>' THEN try_cast(actual AS DOUBLE) > try_cast(expected AS DOUBLE) WHEN '<' THEN try_cast(actual AS DOUBLE) < try_cast(expected AS DOUBLE)
      WHEN '>=' THEN try_cast(actual AS DOUBLE) >= try_cast(expected AS DOUBLE) WHEN '<=' THEN try_cast(actual AS DOUBLE) <= try_cast(expected AS DOUBLE)
      WHEN '!=' THEN try_cast(actual AS DOUBLE) <> try_cast(expected AS DOUBLE) ELSE try_cast(actual AS DOUBLE) = try_cast(expected AS DOUBLE) END
    ELSE CASE op WHEN '>' THEN lower(actual) > lower(expected) WHEN '<' THEN lower(actual) < lower(expected)
      WHEN '>=' THEN lower(actual) >= lower(expected) WHEN '<=' THEN lower(actual) <= lower(expected)
      WHEN '!=' THEN lower(actual) <> lower(expected) ELSE lower(actual) = lower(expected) END END""",
    "fired": """
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rule_id, system_id ORDER BY ingested_at
      RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS recent FROM matched) m
  WHERE recent >= greatest(1, coalesce(threshold, 1))""",
    "native_cand": """
  SELECT sha256('native|' || system_id || '|' || severity || '|' || fault_type || '|' || coalesce(fault_subtype,'UNKNOWN') || '|' || provider_name) AS alert_key,
    'native' AS source_type, CAST(NULL AS BIGINT) AS rule_id, fault_type || ' Detection' AS rule_name, system_id, hostname, severity,
    severity || ': ' || fault_type || ' on ' || hostname AS title, event_message AS description, CAST(NULL AS VARCHAR) AS escalation_target,
    '{"provider_name":"' || provider_name || '"}' AS metadata, id AS source_event_id, ingested_at AS seen_at
  FROM tel WHERE severity IN ('CRITICAL','ERROR','WARNING')""",
    "rule_cand": """
  SELECT sha256('rule|' || CAST(rule_id AS VARCHAR) || '|' || system_id || '|' || severity || '|' || fault_type) AS alert_key,
    'rule' AS source_type, CAST(rule_id AS BIGINT) AS rule_id, rule_name, system_id, hostname, rule_severity AS severity,
    rule_severity || ': ' || rule_name || ' on ' || hostname AS title, 'Rule matched: ' || condition AS description, escalation_target,
    CASE WHEN escalation_target IS NULL THEN '{"escalation_target":null}' ELSE '{"escalation_target":"' || escalation_target || '"}' END AS metadata,
    id AS source_event_id, ingested_at AS seen_at
  FROM fired""",
    "all_cand": "SELECT * FROM native_cand UNION ALL SELECT * FROM rule_cand",
    "alerts": """
  SELECT alert_key, any_value(source_type) AS source_type, any_value(rule_id) AS rule_id, any_value(rule_name) AS rule_name,
    any_value(system_id) AS system_id, any_value(CASE WHEN up = 1 THEN hostname END) AS hostname, any_value(severity) AS severity,
    any_value(CASE WHEN down = 1 THEN title END) AS title, any_value(CASE WHEN down = 1 THEN description END) AS description,
    any_value(CASE WHEN down = 1 THEN metadata END) AS metadata, any_value(CASE WHEN down = 1 THEN source_event_id END) AS source_event_id,
    count(*) AS occurrence_count, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at
  FROM (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY seen_at, source_event_id) AS up,
      row_number() OVER (PARTITION BY alert_key ORDER BY seen_at DESC, source_event_id DESC) AS down FROM native_cand) c
  GROUP BY alert_key""",
    "acks": """
  SELECT alert_key, min(seen_at) + INTERVAL 5 DAYS AS acked_at, 4320 AS cool FROM native_cand GROUP BY 1
  UNION ALL SELECT alert_key, min(seen_at) + INTERVAL 12 DAYS, 4320 FROM native_cand WHERE severity = 'WARNING' GROUP BY 1""",
    "placed": """
  SELECT c.*, coalesce(a.acked_at, TIMESTAMP '1970-01-01') AS last_ack,
    coalesce(c.seen_at < a.acked_at + a.cool * INTERVAL 1 MINUTE, false) AS suppressed
  FROM native_cand c ASOF LEFT JOIN acks a ON a.alert_key = c.alert_key AND c.seen_at >= a.acked_at""",
    "episodes": """
  SELECT *, sum(opens) OVER (PARTITION BY alert_key ORDER BY seen_at, source_event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode
  FROM (SELECT *, CASE WHEN NOT suppressed AND row_number() OVER (PARTITION BY alert_key, last_ack, suppressed ORDER BY seen_at, source_event_id) = 1
      THEN 1 ELSE 0 END AS opens FROM placed) p""",
    "acked_alerts": """
  SELECT e.alert_key, CAST(e.episode AS BIGINT) AS episode, e.severity, e.title, e.description, e.hostname, e.system_id, e.rule_name, e.source_event_id,
    e.occurrence_count, e.first_seen_at, e.last_seen_at, max(a.acked_at) IS NOT NULL AS acknowledged, max(a.acked_at) AS acknowledged_at,
    max(a.acked_at) + INTERVAL 4320 MINUTE AS suppressed_until
  FROM (SELECT *, lead(first_seen_at) OVER (PARTITION BY alert_key ORDER BY episode) AS next_open FROM (
      SELECT alert_key, episode, any_value(severity) AS severity, any_value(system_id) AS system_id, any_value(rule_name) AS rule_name,
        arg_max(title, seen_at) FILTER (WHERE NOT suppressed) AS title, arg_max(description, seen_at) FILTER (WHERE NOT suppressed) AS description,
        arg_min(hostname, seen_at) FILTER (WHERE NOT suppressed) AS hostname, arg_max(source_event_id, seen_at) AS source_event_id,
        count(*) AS occurrence_count, min(seen_at) FILTER (WHERE NOT suppressed) AS first_seen_at, max(seen_at) AS last_seen_at
      FROM episodes GROUP BY alert_key, episode) g) e
  LEFT JOIN acks a ON a.alert_key = e.alert_key AND a.acked_at > e.first_seen_at AND (e.next_open IS NULL OR a.acked_at <= e.next_open)
  GROUP BY ALL""",
    "signals": f"""
  SELECT system_id, fault_type, sub AS fault_subtype, bucket,
    CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END)
      WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'ERROR' WHEN 2 THEN 'WARNING' ELSE 'INFO' END AS severity,
    count(*) AS count, string_agg(DISTINCT label, '|' ORDER BY label) AS systems, count(DISTINCT label) AS n_systems, min(ingested_at) AS first_seen, max(ingested_at) AS last_seen,
    CAST(max(coalesce(confidence_score, 0)) AS DOUBLE) AS max_confidence, count(*) >= 3 AS is_spike,
    system_id || '::' || fault_type || '::' || sub || '::' || CAST(epoch_us(bucket) // 86400000000 AS VARCHAR) AS signal_id
  FROM (SELECT *, coalesce(fault_subtype,'general') AS sub, time_bucket(INTERVAL '1 day', ingested_at, {EPOCH}) AS bucket,
      CASE WHEN hostname = '' THEN system_id ELSE hostname END AS label
    FROM tel WHERE ingested_at > (SELECT as_of FROM clk) - INTERVAL 30 DAYS) s
  GROUP BY system_id, fault_type, sub, bucket""",
    "trend7": """
  SELECT a.system_id, a.prediction_time, a.anomaly_score, a.failure_probability, a.predicted_fault,
    CASE WHEN a.anomaly_score > b.anomaly_score + 0.05 THEN 'rising' WHEN a.anomaly_score < b.anomaly_score - 0.05 THEN 'falling' ELSE 'stable' END AS anomaly_trend,
    CASE WHEN a.failure_probability > b.failure_probability + 0.05 THEN 'rising' WHEN a.failure_probability < b.failure_probability - 0.05 THEN 'falling' ELSE 'stable' END AS risk_trend
  FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY prediction_time DESC) AS r FROM preds7) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY prediction_time DESC) AS r FROM preds7) b
    ON b.system_id = a.system_id AND b.r = 2
  WHERE a.r = 1""",
    "sig_inc": """
  SELECT 'sig::' || s.system_id || '::' || s.fault_type AS incident_key, 'INC-SIG-' || s.signal_id AS incident_id,
    s.fault_type || ' spike ×' || CAST(s.count AS VARCHAR) AS title, s.fault_type,
    CASE WHEN coalesce(t.anomaly_score,0) > 0.85 OR coalesce(t.failure_probability,0) > 0.80 THEN 'CRITICAL'
      WHEN (coalesce(t.anomaly_score,0) > 0.70 OR coalesce(t.failure_probability,0) > 0.60) AND s.severity = 'WARNING' THEN 'ERROR'
      WHEN (coalesce(t.anomaly_score,0) > 0.70 OR coalesce(t.failure_probability,0) > 0.60) AND s.severity = 'ERROR' THEN 'CRITICAL'
      ELSE s.severity END AS severity,
    s.system_id, s.systems, s.n_systems, s.count AS event_count, 'signal' AS trigger, coalesce(t.anomaly_score, 0) AS anomaly_score,
    coalesce(t.failure_probability, 0) AS failure_prob, t.predicted_fault, coalesce(t.anomaly_trend, 'stable') AS trend, s.last_seen AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY system_id, fault_type ORDER BY last_seen DESC,
      CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END DESC, signal_id) AS r
    FROM signals WHERE count >= 3 OR severity IN ('CRITICAL','ERROR')) s
  LEFT JOIN trend7 t ON t.system_id = s.system_id WHERE s.r = 1""",
    "snap_last": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY snapshot_time DESC) AS r FROM snaps7) s WHERE r = 1""",
    "anom_inc": """
  SELECT 'anom::' || p.system_id || '::' || p.predicted_fault AS incident_key, 'INC-ML-ANOM-' || p.system_id AS incident_id,
    'ML anomaly: ' || p.predicted_fault || ' (' || CAST(CAST(floor(p.anomaly_score*100+0.5) AS BIGINT) AS VARCHAR) || '%)' AS title,
    p.predicted_fault AS fault_type, CASE WHEN p.anomaly_score > 0.85 THEN 'CRITICAL' ELSE 'ERROR' END AS severity, p.system_id,
    p.system_id AS systems, 1 AS n_systems, coalesce(l.total_events, 1) AS event_count, 'anomaly' AS trigger, p.anomaly_score,
    p.failure_probability AS failure_prob, p.predicted_fault, t.anomaly_trend AS trend, p.prediction_time AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY system_id, predicted_fault ORDER BY prediction_time DESC) AS r FROM preds7 WHERE anomaly_score > 0.7) p
  LEFT JOIN snap_last l ON l.system_id = p.system_id LEFT JOIN trend7 t ON t.system_id = p.system_id WHERE p.r = 1""",
    "risk_inc": """
  SELECT 'failprob::' || p.system_id || '::' || p.predicted_fault AS incident_key, 'INC-ML-RISK-' || p.system_id AS incident_id,
    'Failure risk: ' || p.predicted_fault || ' (' || CAST(CAST(floor(p.failure_probability*100+0.5) AS BIGINT) AS VARCHAR) || '% prob)' AS title,
    p.predicted_fault AS fault_type, CASE WHEN p.failure_probability > 0.80 THEN 'CRITICAL' ELSE 'ERROR' END AS severity, p.system_id,
    p.system_id AS systems, 1 AS n_systems, coalesce(l.total_events, 1) AS event_count, 'failure_prob' AS trigger, p.anomaly_score,
    p.failure_probability AS failure_prob, p.predicted_fault, t.risk_trend AS trend, p.prediction_time AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY system_id, predicted_fault ORDER BY prediction_time DESC) AS r FROM preds7 WHERE failure_probability > 0.6) p
  LEFT JOIN snap_last l ON l.system_id = p.system_id LEFT JOIN trend7 t ON t.system_id = p.system_id
  WHERE p.r = 1 AND NOT EXISTS (SELECT 1 FROM anom_inc a WHERE a.system_id = p.system_id AND a.fault_type = p.predicted_fault)""",
    "raw_inc": """
  SELECT *, least(0.4 * CASE WHEN event_count <= 1 THEN 0 ELSE least(log2(event_count)/log2(100), 1.0) END + 0.3*anomaly_score + 0.3*failure_prob, 1.0) AS confidence
  FROM (SELECT * FROM sig_inc UNION ALL SELECT * FROM anom_inc UNION ALL SELECT * FROM risk_inc) u""",
    "incidents": """
  SELECT *, CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' WHEN priority_score >= 50 THEN 'HIGH' WHEN priority_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority_label
  FROM (SELECT *, 'OPEN' AS lifecycle, CAST(CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'ERROR' THEN 25 WHEN 'WARNING' THEN 10 ELSE 2 END
      + n_systems*2 + floor(confidence*5 + 0.5)
      + CASE WHEN epoch_us((SELECT as_of FROM clk)) - epoch_us(created_at) < 300000000 THEN 10
             WHEN epoch_us((SELECT as_of FROM clk)) - epoch_us(created_at) < 900000000 THEN 5 ELSE 0 END AS BIGINT) AS priority_score
    FROM raw_inc) i""",
    "fc_hist": """
  SELECT *, CAST(row_number() OVER (PARTITION BY system_id ORDER BY prediction_time) - 1 AS DOUBLE) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY prediction_time DESC) AS newest_no FROM preds1) h WHERE newest_no <= 10""",
    "fc_fit": """
  SELECT f.*, h.failure_probability AS p, h.anomaly_score AS a, (SELECT cpu_usage_percent FROM snaps1 s WHERE s.system_id = f.system_id ORDER BY snapshot_time DESC LIMIT 1) AS cpu_now
  FROM (SELECT system_id, count(*) AS samples, round(regr_slope(failure_probability, x), 12) AS slope, round(regr_r2(failure_probability, x), 12) AS r2 FROM fc_hist GROUP BY 1) f
  JOIN fc_hist h ON h.system_id = f.system_id AND h.newest_no = 1""",
    "forecasts": """
  SELECT *, CASE WHEN p > 0.80 OR (trend = 'rising' AND time_to_failure IS NOT NULL) THEN 'imminent' WHEN p > 0.60 OR trend = 'rising' THEN 'elevated' ELSE 'nominal' END AS risk_level
  FROM (SELECT *, CASE WHEN needed > 0 AND needed < 120 THEN CASE WHEN mins < 1 THEN '< 1 min' WHEN mins < 60 THEN '~' || CAST(mins AS VARCHAR) || ' min'
      WHEN mins % 60 > 0 THEN '~' || CAST(mins // 60 AS VARCHAR) || 'h ' || CAST(mins % 60 AS VARCHAR) || 'm' ELSE '~' || CAST(mins // 60 AS VARCHAR) || 'h' END END AS time_to_failure
    FROM (SELECT *, CAST(floor(needed*30/60 + 0.5) AS BIGINT) AS mins FROM (
      SELECT *, CASE WHEN samples < 2 THEN 'stable' WHEN slope > 0.05 THEN 'rising' WHEN slope < -0.05 THEN 'falling' ELSE 'stable' END AS trend,
        CASE WHEN samples >= 2 AND slope > 0 AND p < 0.9 THEN (0.9 - p)/slope END AS needed,
        floor(CASE WHEN samples < 2 THEN p/2 ELSE least(0.40*least(greatest(coalesce(r2,0),0),1) + 0.35*p + 0.25*a + CASE WHEN cpu_now > 85 THEN 0.05 ELSE 0 END, 1.0) END * 100 + 0.5)/100 AS forecast_conf
      FROM fc_fit) q) r) s""",
}

_ORDER = list(VIEWS)


def with_views(sql: str) -> str:
    """Prefix the statement with the views it needs, directly or through other views."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in _ORDER:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                needed.add(name)
                pending.append(VIEWS[name])
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _ORDER if name in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
