"""Declared schemas and the constants that are part of the query semantics."""

from __future__ import annotations

from pyspark.sql import types as T

PERCENT = T.DecimalType(5, 2)
CONFIDENCE = T.DecimalType(3, 2)
SCORE = T.DecimalType(4, 3)

# Defaults of the reference system, kept as operator parameters.
FEATURE_LOOKBACK_SECONDS = 30
FEATURE_INTERVAL_SECONDS = 30
ML_BATCH_ROWS = 100
ML_MIN_ROWS = 10
FOREST_TREES = 100
FOREST_CONTAMINATION = 0.05
MODEL_SEED = 42
KMEANS_CLUSTERS = 3
KMEANS_RUNS = 10
CPU_ALERT = 90
MEMORY_ALERT = 90
DISK_ALERT = 10
RULE_LOOKBACK_SECONDS = 15 * 60
ACK_COOLDOWN_MINUTES = 30
MAX_LIMIT = 1000
RETENTION_DAYS = 30
RAW_XML_BYTES = 4096
DELTA_CPU = 5.0
DELTA_MEMORY = 5.0
DELTA_DISK = 3.0
RESOURCE_EVENT_SECONDS = 30
OFFLINE_SECONDS = 120
MODEL_VERSION = "v2-isof"
LEVEL_NAMES = {1: "CRITICAL", 2: "ERROR", 3: "WARNING", 4: "INFO", 5: "VERBOSE"}
SEVERITIES = ["INFO", "WARNING", "ERROR", "CRITICAL"]
FEATURES = ["cpu_usage_percent", "memory_usage_percent", "disk_free_percent", "error_count", "critical_count"]


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "decimal(5,2)": PERCENT,
    "decimal(4,3)": SCORE,
    "decimal(3,2)": CONFIDENCE,
}


def _fields(spec: str) -> T.StructType:
    """``name type`` pairs separated by ``, ``; unlike fromDDL this needs no running session."""
    pairs = [item.split(" ", 1) for item in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


COLLECTED_EVENT = _fields(
    "event_hash string, log_channel string, event_record_id bigint, provider_name string, event_id int, level int, "
    "task int, opcode int, keywords string, process_id int, thread_id int, severity string, fault_type string, "
    "fault_subtype string, diagnostic_context string, raw_xml string, event_message string, message string, "
    "cpu_usage_percent double, memory_usage_percent double, disk_free_percent double, confidence_score double, "
    "event_time string"
)

SYSTEM_INFO = _fields(
    "system_id string, hostname string, ip_address string, agent_version string, os_version string, "
    "uptime_seconds bigint, cpu_usage_percent double, memory_usage_percent double, disk_free_percent double"
)

ENVELOPE = T.StructType(
    [
        T.StructField("agent_key", T.StringType()),
        T.StructField("system_id", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("os_version", T.StringType()),
        T.StructField("collector_version", T.StringType()),
        T.StructField("uptime_seconds", T.LongType()),
        T.StructField("timestamp_collected", T.StringType()),
        T.StructField("system_info", SYSTEM_INFO),
        # as JSON text: entries are parsed one by one, so a bad one loses only itself
        T.StructField("events", T.StringType()),
        T.StructField("event", T.StringType()),
    ]
)

EVENTS = _fields(
    "id bigint, system_id string, hostname string, log_channel string, event_record_id bigint, provider_name string, "
    "event_id int, level int, task int, opcode int, keywords string, process_id int, thread_id int, severity string, "
    "fault_type string, diagnostic_context string, event_hash string, raw_xml string, "
    "cpu_usage_percent decimal(5,2), memory_usage_percent decimal(5,2), disk_free_percent decimal(5,2), "
    "ingested_at timestamp, event_message string, parsed_message string, normalized_message string, "
    "fault_subtype string, confidence_score decimal(3,2), acknowledged boolean, acknowledged_at timestamp, "
    "escalated boolean, escalated_at timestamp, assigned_to string"
)

HEARTBEATS = _fields(
    "system_id string, hostname string, cpu_usage_percent decimal(5,2), memory_usage_percent decimal(5,2), "
    "disk_free_percent decimal(5,2), os_version string, agent_version string, ip_address string, "
    "uptime_seconds bigint, last_seen timestamp"
)

SNAPSHOTS = _fields(
    "system_id string, snapshot_time timestamp, cpu_usage_percent decimal(5,2), memory_usage_percent decimal(5,2), "
    "disk_free_percent decimal(5,2), total_events bigint, critical_count bigint, error_count bigint, "
    "warning_count bigint, info_count bigint, dominant_fault_type string, avg_confidence decimal(3,2)"
)

SNAPSHOT_DEFAULTS = {
    "cpu_usage_percent": 0,
    "memory_usage_percent": 0,
    "disk_free_percent": 100,
    "total_events": 0,
    "critical_count": 0,
    "error_count": 0,
    "warning_count": 0,
    "info_count": 0,
    "dominant_fault_type": "NONE",
    "avg_confidence": 0.20,
}

PREDICTIONS = _fields(
    "system_id string, prediction_time timestamp, anomaly_score decimal(4,3), is_anomaly boolean, "
    "failure_probability decimal(4,3), predicted_fault string, cluster_id int, model_version string"
)

RULES = _fields(
    "id bigint, rule_name string, condition string, severity string, threshold int, cooldown_minutes int, "
    "escalation_target string, enabled boolean"
)

# Columns of the star-schema ``events`` table. Reading ``ts`` as TIMESTAMP (session zone UTC) instead of the
# inferred TIMESTAMP_NTZ keeps time filters pushable and lets the same code run with watermarks.
RAW_EVENTS = _fields("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
