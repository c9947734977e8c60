"""Alert candidates, roll-up into alert rows, backfills, acknowledgement and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.functions.clock import in_window
from fleetsight.functions.coerce import first_text, strip, text_or
from fleetsight.functions.ordered import latest_per_key
from fleetsight.functions.text import alert_number, merge_json, native_alert_key, rule_alert_key
from fleetsight.operators.rules import LIVE_FIELDS, firing_matches, match_rules
from fleetsight.operators.shaping import host_label
from fleetsight.schemas import ACK_COOLDOWN_MINUTES, RULE_LOOKBACK_SECONDS

SEVERE = ("CRITICAL", "ERROR", "WARNING")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _description(df: DataFrame, fallback: Column) -> Column:
    return F.coalesce(first_text(strip(_column(df, "parsed_message")), strip(_column(df, "event_message"))), fallback)


def native_candidates(events: DataFrame) -> DataFrame:
    """One candidate per severe event. The key uses the severity as stored."""
    upper = F.upper(text_or(F.col("severity"), "INFO"))
    system = text_or(F.col("system_id"), "unknown")
    host = F.coalesce(strip(F.col("hostname")), system)
    fault = text_or(F.col("fault_type"), "Unknown")
    rows = events.filter(upper.isin(*SEVERE))
    return rows.select(
        native_alert_key(F.col("system_id"), F.col("severity"), F.col("fault_type"), F.col("fault_subtype"), F.col("provider_name")).alias("alert_key"),
        F.lit("native").alias("source_type"),
        F.lit(None).cast("bigint").alias("rule_id"),
        F.concat(fault, F.lit(" Detection")).alias("rule_name"),
        system.alias("system_id"),
        host.alias("hostname"),
        upper.alias("severity"),
        F.concat(upper, F.lit(": "), fault, F.lit(" on "), host).alias("title"),
        _description(events, fault).alias("description"),
        F.lit(None).cast("string").alias("escalation_target"),
        F.to_json(F.struct("provider_name")).alias("metadata"),
        F.col("id").alias("source_event_id"),
        F.col("ingested_at").alias("seen_at"),
    )


def rule_candidates(
    events: DataFrame, rules: DataFrame, lookback_seconds: int = RULE_LOOKBACK_SECONDS, fields: list[str] = LIVE_FIELDS, **kw
) -> DataFrame:
    """One candidate per (event, rule) match that reaches the rule's threshold within the lookback."""
    keep = ["id", "system_id", "hostname", "severity", "fault_type", "ingested_at"]
    fired = firing_matches(match_rules(events, rules, keep, fields), lookback_seconds, **kw)
    system = text_or(F.col("system_id"), "unknown")
    host = F.coalesce(strip(F.col("hostname")), system)
    severity = F.upper(F.coalesce(strip(F.col("rule_severity")), F.upper(text_or(F.col("severity"), "INFO"))))
    name = text_or(F.col("rule_name"), "Custom Rule")
    target = strip(F.col("escalation_target"))
    return fired.select(
        rule_alert_key(F.col("rule_id"), F.col("system_id"), F.col("severity"), F.col("fault_type")).alias("alert_key"),
        F.lit("rule").alias("source_type"),
        "rule_id",
        name.alias("rule_name"),
        system.alias("system_id"),
        host.alias("hostname"),
        severity.alias("severity"),
        F.concat(severity, F.lit(": "), name, F.lit(" on "), host).alias("title"),
        F.concat(F.lit("Rule matched: "), text_or(F.col("condition"))).alias("description"),
        F.nullif(target, F.lit("")).alias("escalation_target"),
        F.to_json(F.struct("escalation_target"), {"ignoreNullFields": "false"}).alias("metadata"),
        F.col("id").alias("source_event_id"),
        F.col("ingested_at").alias("seen_at"),
    )


def alert_candidates(events: DataFrame, rules: DataFrame, lookback_seconds: int = RULE_LOOKBACK_SECONDS) -> DataFrame:
    """Native and rule candidates together."""
    return native_candidates(events).unionByName(rule_candidates(events, rules, lookback_seconds))


_FIXED = ["source_type", "rule_id", "rule_name", "system_id", "hostname", "severity"]
_FRESH = ["title", "description", "escalation_target", "metadata"]


def roll_up(candidates: DataFrame) -> DataFrame:
    """Alert rows when nothing was acknowledged: one active row per key.

    One keyed aggregate: identity from the first candidate, text from the last. Texts in the state make it a sort
    aggregate, so map tasks sort their candidates, and one row per key and task is shuffled.
    """
    place = F.struct("seen_at", "source_event_id")
    grouped = candidates.groupBy("alert_key").agg(
        F.min_by(F.struct(*_FIXED), place).alias("first"),
        F.max_by(F.struct(*_FRESH, "source_event_id"), place).alias("last"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
    )
    return grouped.select(
        "alert_key", "first.*", "last.*", "occurrence_count", "first_seen_at", "last_seen_at", F.lit(False).alias("acknowledged")
    )


def roll_up_with_acks(candidates: DataFrame, acks: DataFrame, default_cooldown: int = ACK_COOLDOWN_MINUTES) -> DataFrame:
    """Alert rows (episodes) per key given an acknowledgement log (alert_key, acked_at[, cooldown_minutes]).

    The keyed upsert is order-dependent, but only acknowledgements change its state: between two of them a
    candidate either falls into the suppression period (it only bumps the current row) or not (it belongs to the
    episode that the first such candidate opened). So candidates are reduced per (key, interval, suppressed) with
    map-side combine, and the episode numbers come from a running sum over those few rows.
    """
    cooldown = F.coalesce(F.nullif("cooldown_minutes", F.lit(0)), F.lit(default_cooldown)) if "cooldown_minutes" in acks.columns else F.lit(default_cooldown)
    by_key = Window.partitionBy("alert_key").orderBy("acked_at")
    log = (
        acks.withColumn("cool", cooldown)
        .groupBy("alert_key", "acked_at")
        .agg(F.max("cool").alias("cool"))
        .withColumn("ack_no", F.row_number().over(by_key))
        .withColumn("next_ack", F.lead("acked_at").over(by_key))
        .withColumn("until", F.col("acked_at") + F.make_dt_interval(mins=F.col("cool")))
    )
    right = log.select(F.col("alert_key").alias("k"), "acked_at", "next_ack", "until", "ack_no")
    inside = (
        (F.col("alert_key") == F.col("k"))
        & (F.col("seen_at") >= F.col("acked_at"))
        & (F.col("next_ack").isNull() | (F.col("seen_at") < F.col("next_ack")))
    )
    placed = candidates.join(right, inside, "left").withColumns(
        {
            "ack_no": F.coalesce("ack_no", F.lit(0)),
            "suppressed": F.coalesce(F.col("seen_at") < F.col("until"), F.lit(False)),
        }
    )
    place = F.struct("seen_at", "source_event_id")
    parts = placed.groupBy("alert_key", "ack_no", "suppressed").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("seen_at").alias("lo"),
        F.max(place).alias("hi"),
        F.min_by(F.struct(*_FIXED), place).alias("first"),
        F.max_by(F.struct(*_FRESH), place).alias("last"),
    )
    # Suppressed rows sort before the new ones of the same interval. A key's very first row opens an episode even if
    # an early acknowledgement seems to suppress it: there was no alert yet. The new rows after it then only continue.
    order = Window.partitionBy("alert_key").orderBy("ack_no", F.col("suppressed").desc())
    parts = parts.withColumn("premature", (F.row_number().over(order) == 1) & F.col("suppressed"))
    continues = F.coalesce(F.lag("premature").over(order) & (F.lag("ack_no").over(order) == F.col("ack_no")), F.lit(False))
    opens = F.col("premature") | (~F.col("suppressed") & ~continues)
    parts = parts.withColumn("opens", opens.cast("int"))
    parts = parts.withColumn("episode", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    new = ~F.col("suppressed") | F.col("premature")
    rows = parts.groupBy("alert_key", "episode").agg(
        F.min_by(F.when(new, F.col("first")), F.when(new, F.col("lo"))).alias("first"),
        F.max_by(F.when(new, F.col("last")), F.when(new, F.col("hi"))).alias("last"),
        F.max("hi").alias("hi"),
        F.sum("n").alias("occurrence_count"),
        F.min(F.when(new, F.col("lo"))).alias("first_seen_at"),
        F.min(F.when(new, F.col("ack_no"))).alias("opened_in"),
    )
    following = F.lead("opened_in").over(Window.partitionBy("alert_key").orderBy("episode"))
    rows = rows.withColumn("closed_by", F.coalesce(following, F.lit(2147483647)))
    applied = (F.col("alert_key") == F.col("k")) & (F.col("ack_no") > F.col("opened_in")) & (F.col("ack_no") <= F.col("closed_by"))
    acked = rows.join(right.select("k", "ack_no", "acked_at", "until"), applied, "left")
    acked = acked.groupBy("alert_key", "episode").agg(F.max("acked_at").alias("acknowledged_at"), F.max_by("until", "acked_at").alias("suppressed_until"))
    return rows.join(acked, ["alert_key", "episode"]).select(
        "alert_key",
        F.col("episode").cast("int").alias("episode"),
        "first.*",
        "last.*",
        F.col("hi.source_event_id").alias("source_event_id"),
        "occurrence_count",
        "first_seen_at",
        F.col("hi.seen_at").alias("last_seen_at"),
        F.col("acknowledged_at").isNotNull().alias("acknowledged"),
        "acknowledged_at",
        "suppressed_until",
    )


def backfill_native(events: DataFrame, alerts: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Alerts from severe events (all, or the newest ``limit``): newest event per key, unless the key has an active alert."""
    severe = events.filter(F.col("severity").isin(*SEVERE)).withColumn("hostname", host_label())
    if limit:
        severe = severe.orderBy(F.col("ingested_at").desc(), F.col("id").desc()).limit(limit)
    newest = latest_per_key(native_candidates(severe), ["alert_key"], F.col("seen_at").desc(), F.col("source_event_id").desc())
    rows = newest.withColumn("occurrence_count", F.lit(1).cast("bigint")).withColumns(
        {"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")}
    ).drop("seen_at")
    return without_active(rows, alerts)


def without_active(rows: DataFrame, alerts: DataFrame | None) -> DataFrame:
    """Drop rows whose key already has an unacknowledged alert."""
    if alerts is None:
        return rows
    active = alerts.filter(~F.coalesce("acknowledged", F.lit(False))).select("alert_key")
    return rows.join(active, "alert_key", "left_anti")


def backfill_rules(
    events: DataFrame,
    rules: DataFrame,
    as_of,
    alerts: DataFrame | None = None,
    lookback_seconds: float = RULE_LOOKBACK_SECONDS,
    limit: int | None = None,
) -> DataFrame:
    """Seed alerts for rules: matches of the recent events per (rule, host) that reach the threshold.

    The whole window is evaluated unless ``limit`` asks for its newest events only.
    """
    recent = events.filter(in_window(F.col("ingested_at"), as_of, lookback_seconds, inclusive=True))
    recent = recent.withColumn("hostname", host_label())
    if limit:
        recent = recent.orderBy(F.col("ingested_at").desc(), F.col("id").desc()).limit(limit)
    keep = ["id", "system_id", "hostname", "severity", "fault_type", "ingested_at"]
    matched = match_rules(recent, rules, keep)
    newest = F.struct("id", "hostname", "severity", "fault_type", "ingested_at")
    grouped = matched.groupBy("rule_id", "rule_name", "condition", "rule_severity", "threshold", "escalation_target", "system_id").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.max_by(newest, F.struct("ingested_at", "id")).alias("newest")
    )
    hit = grouped.filter(F.col("occurrence_count") >= F.greatest(F.lit(1), F.coalesce(F.nullif("threshold", F.lit(0)), F.lit(1))))
    severity = F.coalesce(strip(F.col("rule_severity")), F.col("newest.severity"), F.lit("WARNING"))
    rows = hit.select(
        rule_alert_key(F.col("rule_id"), F.col("system_id"), F.col("newest.severity"), F.col("newest.fault_type")).alias("alert_key"),
        F.lit("rule").alias("source_type"),
        "rule_id",
        "rule_name",
        "system_id",
        F.col("newest.hostname").alias("hostname"),
        severity.alias("severity"),
        F.concat(severity, F.lit(": "), text_or(F.col("rule_name"), "Custom Rule"), F.lit(" on "), F.col("newest.hostname")).alias("title"),
        F.concat(F.lit("Rule matched: "), text_or(F.col("condition"))).alias("description"),
        "escalation_target",
        F.to_json(F.struct(F.lit(True).alias("backfilled"), F.col("occurrence_count").alias("match_count"))).alias("metadata"),
        F.col("newest.id").alias("source_event_id"),
        "occurrence_count",
        F.col("newest.ingested_at").alias("first_seen_at"),
        F.col("newest.ingested_at").alias("last_seen_at"),
    )
    return without_active(rows, alerts)


def _latest_action(actions: DataFrame) -> DataFrame:
    """Newest action per alert; malformed alert ids are dropped."""
    numbered = actions.withColumn("__alert", alert_number(F.col("alert_id"))).filter(F.col("__alert").isNotNull())
    return latest_per_key(numbered, ["__alert"], F.col("at").desc(), F.col("user_id").asc())


def acknowledge(alerts: DataFrame, actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply acknowledgements (alert_id, user_id, at): flags, suppression until at + cooldown, metadata patch."""
    latest = _latest_action(actions).select(F.col("__alert").alias("id"), "user_id", "at")
    cool = rules.select(F.col("id").alias("rule_id"), "cooldown_minutes")
    rows = alerts.join(latest, "id", "left").join(cool, "rule_id", "left")
    minutes = F.coalesce(F.nullif("cooldown_minutes", F.lit(0)), F.lit(ACK_COOLDOWN_MINUTES))
    hit = F.col("at").isNotNull()
    patch = F.to_json(F.struct(F.col("user_id").alias("acknowledged_by")))
    have = set(alerts.columns)

    def old(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    changed = rows.withColumns(
        {
            "acknowledged": F.when(hit, True).otherwise(F.coalesce(old("acknowledged", "boolean"), F.lit(False))),
            "acknowledged_at": F.when(hit, F.col("at")).otherwise(old("acknowledged_at", "timestamp")),
            "suppressed_until": F.when(hit, F.col("at") + F.make_dt_interval(mins=minutes)).otherwise(old("suppressed_until", "timestamp")),
            "metadata": F.when(hit, merge_json(F.col("metadata"), patch)).otherwise(F.col("metadata")),
        }
    )
    return changed.drop("user_id", "at", "cooldown_minutes")


def acknowledged_events(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Source events flagged by the acknowledgements."""
    latest = _latest_action(actions).select(F.col("__alert").alias("id"), "at")
    return alerts.join(latest, "id").select(F.col("source_event_id").alias("event_id"), F.col("at").alias("acknowledged_at"))


def escalate(alerts: DataFrame, actions: DataFrame, default_target: str = "") -> DataFrame:
    """Apply escalations (alert_id, user_id, at, delivery_status): flag, target and delivery status.

    Delivery itself happens elsewhere; its outcome arrives as ``delivery_status`` and defaults to ``queued``, or
    ``no_target`` when neither the alert nor the default names one.
    """
    latest = _latest_action(actions).select(F.col("__alert").alias("id"), "at", "delivery_status")
    rows = alerts.join(latest, "id", "left")
    target = F.nullif(strip(F.coalesce(F.nullif("escalation_target", F.lit("")), F.lit(default_target))), F.lit(""))
    hit = F.col("at").isNotNull()
    status = F.when(target.isNull(), "no_target").otherwise(F.coalesce("delivery_status", F.lit("queued")))
    return rows.withColumns(
        {
            "escalated": F.coalesce(hit, F.lit(False)),
            "escalated_at": F.col("at"),
            "escalation_status": F.when(hit, status),
            "escalation_target": F.when(hit, F.coalesce(target, F.col("escalation_target"))).otherwise(F.col("escalation_target")),
        }
    ).drop("at", "delivery_status")


def audit_rows(actions: DataFrame, action: str) -> DataFrame:
    """Audit entries of valid actions."""
    numbered = actions.withColumn("n", alert_number(F.col("alert_id"))).filter(F.col("n").isNotNull())
    return numbered.select(
        F.coalesce("user_id", F.lit("anonymous")).alias("user_id"), F.lit(action).alias("action"), F.col("n").cast("string").alias("resource_id"), F.col("at")
    )


def numbered_alerts(alerts: DataFrame, ts: str = "first_seen_at") -> DataFrame:
    """Surrogate id from the key, stable under re-computation and free of any global ordering."""
    return alerts.withColumn("id", F.pmod(F.xxhash64("alert_key", ts), F.lit(1 << 52)))


def new_rule(rules: DataFrame) -> DataFrame:
    """Rows to append for created rules: cooldown at least 1, blank target becomes NULL."""
    return rules.withColumns(
        {
            "cooldown_minutes": F.greatest(F.lit(1), F.coalesce("cooldown_minutes", F.lit(ACK_COOLDOWN_MINUTES))),
            "escalation_target": F.nullif(strip(F.col("escalation_target")), F.lit("")),
            "enabled": F.lit(True),
        }
    )
