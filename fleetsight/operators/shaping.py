"""Search, filters and row shaping (section P of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.clock import at, before, seconds_between
from fleetsight.functions.coerce import blank_to_null, bounded_limit, clamp, first_text, float_or
from fleetsight.functions.severity import severity_rank
from fleetsight.functions.text import clean_message, contains_any, diagnostic_text, search_any, truncate_utf8
from fleetsight.schemas import CONFIDENCE, OFFLINE_SECONDS, PERCENT, RAW_XML_BYTES

# Providers that are never collected (case-insensitive substrings).
EXCLUDED_PROVIDERS = ["tcpip", "dns", "dhcp", "wlan", "smb", "network", "firewall", "winhttp", "wininet"]


def host_label(hostname: str = "hostname", system_id: str = "system_id") -> Column:
    return F.coalesce(blank_to_null(F.col(hostname)), F.col(system_id))


def newest(rows: DataFrame, time_column: str, limit, *tie: str, default: int = 100, high: int | None = None) -> DataFrame:
    """Newest-N with a deterministic tie-break; plans as TakeOrderedAndProject."""
    order = [F.col(time_column).desc_nulls_last(), *[F.col(t).desc() for t in tie]]
    return rows.orderBy(*order).limit(bounded_limit(limit, default, 1, high))


def search_events(
    events: DataFrame,
    limit=100,
    system_id: str | None = None,
    severity: str | None = None,
    fault_type: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Equality filters ANDed with a wildcard search over eight columns, newest first."""
    rows = filter_events(events, system_id, severity, fault_type, search)
    return newest(rows, "ingested_at", limit, "id")


def filter_events(
    events: DataFrame,
    system_id: str | None = None,
    severity: str | None = None,
    fault_type: str | None = None,
    search: str | None = None,
) -> DataFrame:
    rows = events
    for name, wanted in (("system_id", system_id), ("severity", severity), ("fault_type", fault_type)):
        if wanted:
            rows = rows.filter(F.col(name) == wanted)
    if search:
        searched = [
            "fault_type",
            "system_id",
            "hostname",
            "provider_name",
            "event_message",
            "parsed_message",
            "normalized_message",
            "diagnostic_context",
        ]
        rows = rows.filter(search_any(search, *[F.col(c) for c in searched if c in rows.columns]))
    return rows


def shape_event(events: DataFrame) -> DataFrame:
    """Consumer shape: numeric defaults, blanks for missing text, a description, no raw XML."""
    have = set(events.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")

    described = first_text(diagnostic_text(F.col("diagnostic_context")), text("parsed_message"), text("event_message"), F.col("fault_type"))
    shaped = events.withColumns(
        {
            "fault_description": F.coalesce(described, F.lit("")),
            "cpu_usage_percent": F.coalesce("cpu_usage_percent", F.lit(0).cast(PERCENT)),
            "memory_usage_percent": F.coalesce("memory_usage_percent", F.lit(0).cast(PERCENT)),
            "disk_free_percent": F.coalesce("disk_free_percent", F.lit(0).cast(PERCENT)),
            "confidence_score": F.coalesce("confidence_score", F.lit(0.20).cast(CONFIDENCE)),
            "event_message": text("event_message"),
            "parsed_message": text("parsed_message"),
            "normalized_message": text("normalized_message"),
            "fault_subtype": text("fault_subtype"),
            "event_record_id": F.col("id"),
            "hostname": host_label(),
            "event_time": F.col("ingested_at"),
        }
    )
    return shaped.drop("raw_xml")


def sanitize_event(events: DataFrame, as_of) -> DataFrame:
    """Fallbacks a consumer applies: host label, event time, description."""
    have = set(events.columns)
    times = [F.col(c) for c in ("event_time", "ingested_at") if c in have]
    texts = [F.col(c) for c in ("fault_description", "parsed_message", "event_message", "fault_type") if c in have]
    return events.withColumns(
        {
            "hostname": host_label(),
            "event_time": F.coalesce(*times, at(as_of)),
            "fault_description": first_text(*texts),
        }
    ).drop("raw_xml")


def shape_alert(alerts: DataFrame) -> DataFrame:
    """Consumer shape of an alert row."""
    by = F.get_json_object("metadata", "$.acknowledged_by")
    acknowledged = F.coalesce("acknowledged", F.lit(False))
    return alerts.select(
        F.concat(F.lit("ALERT-"), F.col("id").cast("string")).alias("alert_id"),
        F.coalesce("system_id", F.lit("unknown")).alias("system_id"),
        F.coalesce(host_label(), F.lit("unknown")).alias("hostname"),
        F.coalesce("severity", F.lit("WARNING")).alias("severity"),
        F.coalesce("rule_name", F.lit("Unknown Rule")).alias("rule"),
        F.coalesce("title", F.lit("Untitled Alert")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("first_seen_at", "last_seen_at").alias("triggered_at"),
        acknowledged.alias("acknowledged"),
        F.col("acknowledged_at"),
        F.coalesce("escalated", F.lit(False)).alias("escalated"),
        F.col("escalated_at"),
        F.col("assigned_to"),
        F.coalesce("occurrence_count", F.lit(1)).alias("occurrence_count"),
        by.alias("acknowledged_by"),
        F.when(acknowledged, "acknowledged").otherwise("active").alias("status"),
    )


def kept_provider(c: Column) -> Column:
    """False for providers on the exclusion list."""
    return ~F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(EXCLUDED_PROVIDERS))


def collected_level(c: Column) -> Column:
    """Levels 1 to 3 are collected; a missing level counts as 4."""
    return F.coalesce(c, F.lit(4)).isin(1, 2, 3)


def dashboard_events(
    events: DataFrame,
    as_of,
    range_seconds: float,
    systems: list[str] = (),
    severities: list[str] = (),
    faults: list[str] = (),
    query: str = "",
) -> DataFrame:
    """Multi-filter of the dashboard; a system matches by id or host name, the query by plain substring."""
    rows = events.filter(F.col("ingested_at") >= before(as_of, range_seconds))
    if systems:
        rows = rows.filter(F.col("system_id").isin(*systems) | F.col("hostname").isin(*systems))
    if severities:
        rows = rows.filter(F.col("severity").isin(*severities))
    if faults:
        rows = rows.filter(F.col("fault_type").isin(*faults))
    if query:
        described = F.col("fault_description") if "fault_description" in rows.columns else F.col("event_message")
        code = F.col("event_code").cast("string")
        fields = [described, F.col("hostname"), F.col("system_id"), F.col("fault_type"), F.col("provider_name"), code]
        rows = rows.filter(contains_any(query, *fields))
    return rows


def dashboard_alerts(
    alerts: DataFrame,
    as_of,
    range_seconds: float,
    systems: list[str] = (),
    severities: list[str] = (),
    query: str = "",
    active_cap: int | None = None,
) -> DataFrame:
    """Only acknowledged alerts are bound by time; ``active_cap`` keeps the newest unacknowledged ones only."""
    rows = alerts
    if systems:
        rows = rows.filter(F.col("system_id").isin(*systems) | F.col("hostname").isin(*systems))
    if severities:
        rows = rows.filter(F.col("severity").isin(*severities))
    if query:
        rows = rows.filter(contains_any(query, F.col("rule_name"), F.col("title"), F.col("hostname")))
    acked = F.coalesce("acknowledged", F.lit(False))
    done = rows.filter(acked & (F.col("first_seen_at") >= before(as_of, range_seconds)))
    active = rows.filter(~acked)
    if active_cap:
        active = active.orderBy(F.col("last_seen_at").desc(), F.col("alert_key")).limit(active_cap)
    return active.unionByName(done)


def dashboard_systems(systems: DataFrame, selected: list[str] = (), query: str = "") -> DataFrame:
    rows = systems
    if selected:
        rows = rows.filter(F.col("system_id").isin(*selected) | F.col("hostname").isin(*selected))
    if query:
        rows = rows.filter(contains_any(query, F.col("hostname"), F.col("system_id")))
    return rows


def host_status(critical: Column, cpu: Column, memory: Column, last_seen: Column, as_of) -> Column:
    """offline beats degraded beats online; a host without last_seen is not offline."""
    age = seconds_between(at(as_of), last_seen)
    degraded = (F.coalesce(critical, F.lit(0)) >= 3) | (float_or(cpu) > 90) | (float_or(memory) > 95)
    return F.when(F.coalesce(age > OFFLINE_SECONDS, F.lit(False)), "offline").when(degraded, "degraded").otherwise("online")


def live_status(heartbeats: DataFrame, as_of, offline_seconds: int = OFFLINE_SECONDS) -> DataFrame:
    """Heartbeat-only status per host."""
    age = seconds_between(at(as_of), F.col("last_seen"))
    return heartbeats.withColumns(
        {
            "hostname": F.coalesce("hostname", F.lit("")),
            "online": F.coalesce(age <= offline_seconds, F.lit(True)),
            "cpu_usage_percent": F.coalesce("cpu_usage_percent", F.lit(0).cast(PERCENT)),
            "memory_usage_percent": F.coalesce("memory_usage_percent", F.lit(0).cast(PERCENT)),
            "disk_free_percent": F.coalesce("disk_free_percent", F.lit(100).cast(PERCENT)),
        }
    )


def liveness(heartbeats: DataFrame, as_of, alive_seconds: float = 5, idle_seconds: float = 30) -> DataFrame:
    """Alive while the last sign is younger than ``alive_seconds``; idle once it is older than ``idle_seconds``."""
    age = seconds_between(at(as_of), F.col("last_seen"))
    return heartbeats.select(
        "system_id",
        age.alias("age_seconds"),
        F.coalesce(age < alive_seconds, F.lit(False)).alias("is_alive"),
        F.coalesce(age > idle_seconds, F.lit(True)).alias("is_idle"),
        F.coalesce(age > OFFLINE_SECONDS, F.lit(False)).alias("is_offline"),
    )


def freshness(events: DataFrame, as_of) -> DataFrame:
    """One row: how old the newest event is. An empty table is OK with delay 0."""
    age = seconds_between(at(as_of), F.col("latest"))
    status = F.when(F.col("latest").isNull() | (age < 60), "OK").when(age < 300, "DEGRADED").otherwise("DOWN")
    return events.agg(F.max("ingested_at").alias("latest")).select(
        status.alias("status"), F.coalesce(age.cast("bigint"), F.lit(0).cast("bigint")).alias("delay_seconds")
    )


def prepared_rows(exploded: DataFrame) -> DataFrame:
    """Envelope event -> stored row: message fallback, XML cut, cleaned text, subtype and metric fallbacks.

    Expects the columns ``system_id``, ``hostname``, ``system_info`` (struct) and ``event`` (struct).
    """
    e = F.col("event")
    raw = F.coalesce(first_text(e["event_message"], e["message"]), F.lit(""))
    cleaned = clean_message(raw)

    def metric(name: str, fallback: float) -> Column:
        return F.coalesce(e[name], F.col("system_info")[name], F.lit(float(fallback))).cast(PERCENT)

    copied = [
        "log_channel", "event_record_id", "provider_name", "event_id", "level", "task", "opcode", "keywords",
        "process_id", "thread_id", "severity", "fault_type",
    ]
    extra = [c for c in ("ingested_at", "dedupe_key") if c in exploded.columns]
    return exploded.select(
        "system_id",
        "hostname",
        *[e[c].alias(c) for c in copied],
        F.coalesce(first_text(e["diagnostic_context"]), F.lit("{}")).alias("diagnostic_context"),
        e["event_hash"].alias("event_hash"),
        truncate_utf8(e["raw_xml"], RAW_XML_BYTES).alias("raw_xml"),
        metric("cpu_usage_percent", 0).alias("cpu_usage_percent"),
        metric("memory_usage_percent", 0).alias("memory_usage_percent"),
        metric("disk_free_percent", 100).alias("disk_free_percent"),
        raw.alias("event_message"),
        cleaned.alias("parsed_message"),
        F.lower(cleaned).alias("normalized_message"),
        F.coalesce(first_text(e["fault_subtype"], e["fault_type"]), F.lit("UNKNOWN")).alias("fault_subtype"),
        clamp(F.coalesce(e["confidence_score"], F.lit(0.20)), 0.0, 1.0).cast(CONFIDENCE).alias("confidence_score"),
        *extra,
    )


def host_metric(info: Column, first_event: Column, name: str, fallback: float) -> Column:
    """Heartbeat reading, else the first event's, else the default. A struct cannot tell a missing key from NULL,
    so a NULL heartbeat reading falls through to the event (the reference would go to the default)."""
    return F.coalesce(info[name], first_event[name], F.lit(float(fallback)))


def resource_series(events: DataFrame, system_id: str | None = None) -> DataFrame:
    """(time, cpu, memory, disk) of the given events, one host or all."""
    rows = events.filter(F.col("system_id") == system_id) if system_id else events
    return rows.select(
        "system_id",
        F.col("ingested_at").alias("time"),
        F.col("cpu_usage_percent").alias("cpu"),
        F.col("memory_usage_percent").alias("memory"),
        F.col("disk_free_percent").alias("disk"),
    )


def severity_series(metric_points: DataFrame) -> DataFrame:
    return metric_points.select(
        F.col("bucket").alias("time"),
        F.col("critical_count").alias("critical"),
        F.col("error_count").alias("error"),
        F.col("warning_count").alias("warning"),
        F.col("info_count").alias("info"),
    )


def spike_or_critical(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("is_spike") | (F.col("severity") == "CRITICAL"))


def without_low_priority(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("priority_label") != "LOW")


def noise_summary(rows: DataFrame, shown: Column) -> DataFrame:
    """Shown and hidden row counts in one pass."""
    return rows.agg(F.count_if(shown).alias("shown"), F.count_if(~shown).alias("hidden"))


def sort_alerts(alerts: DataFrame, key: str = "severity", descending: bool = True) -> DataFrame:
    column = {"severity": severity_rank(F.col("severity")), "age": F.col("first_seen_at"), "system": F.col("hostname")}[key]
    return alerts.orderBy(column.desc() if descending else column.asc(), F.col("alert_key"))


def sort_systems(systems: DataFrame, key: str = "status", descending: bool = True) -> DataFrame:
    rank = F.when(F.col("status") == "offline", 0).when(F.col("status") == "degraded", 1).otherwise(2)
    column = {
        "hostname": F.col("hostname"),
        "status": rank,
        "cpu": F.col("cpu_usage_percent"),
        "mem": F.col("memory_usage_percent"),
        "events": F.col("total_events"),
    }[key]
    return systems.orderBy(column.desc() if descending else column.asc(), F.col("system_id"))


