"""Per-host feature statistics and snapshots."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.clock import at, in_window
from fleetsight.functions.coerce import conform
from fleetsight.schemas import (
    FEATURE_LOOKBACK_SECONDS,
    PERCENT,
    CONFIDENCE,
    SNAPSHOT_DEFAULTS,
    SNAPSHOTS,
)

ZERO_STATS = {k: SNAPSHOT_DEFAULTS[k] for k in list(SNAPSHOT_DEFAULTS)[3:]}


def severity_counts(c: Column | None = None) -> list[Column]:
    """Four severity counters; all are partial aggregates, so hot hosts are combined before the shuffle."""
    sev = F.col("severity") if c is None else c
    return [
        F.count_if(sev == name).alias(f"{name.lower()}_count") for name in ("CRITICAL", "ERROR", "WARNING", "INFO")
    ]


def stat_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_events"),
        *severity_counts(),
        F.mode("fault_type", True).alias("dominant_fault_type"),
        F.round(F.avg(F.coalesce(F.col("confidence_score"), F.lit(0.20).cast(CONFIDENCE))), 2)
        .cast(CONFIDENCE)
        .alias("avg_confidence"),
    ]


def time_and_id(ts: str, tie: str) -> Column:
    """(time, id) as one number that sorts alike; unlike a struct it fits the fixed-width state of a hash aggregate."""
    step = F.lit(Decimal(2 * 10**19)).cast("decimal(20,0)")  # more than the number of 64-bit ids
    return F.unix_micros(ts).cast("decimal(17,0)") * step + F.coalesce(F.col(tie), F.lit(0)).cast("decimal(19,0)")


def combined_stats(rows: DataFrame, keys: list[str], newest: tuple[str, ...] = (), place: Column | None = None) -> DataFrame:
    """The statistics per key, and of some columns the value at the highest ``place``, in two hash aggregates.

    ``mode`` keeps a map per group and falls back to sorting its input once a task sees more than a few groups.
    Counting per (key, fault) first needs only fixed-width buffers, so the pass over the data stays a hash
    aggregate; the second level sees one row per key and fault. Ties of the dominant fault go to the smaller name.
    """
    confidence = F.coalesce(F.col("confidence_score"), F.lit(0.20).cast(CONFIDENCE))
    per_fault = rows.groupBy(*keys, "fault_type").agg(
        F.count(F.lit(1)).alias("n"), *severity_counts(), F.sum(confidence).alias("confidence"),
        *([F.max(place).alias("__place")] if newest else []), *[F.max_by(c, place).alias(c) for c in newest],
    )
    names = ["critical_count", "error_count", "warning_count", "info_count"]
    known = F.col("fault_type").isNotNull()
    frequent = F.when(known, F.struct((-F.col("n")).alias("rank"), F.col("fault_type").alias("name")))
    mean = F.round(F.try_divide(F.sum("confidence"), F.sum("n")), 2).cast(CONFIDENCE)
    return per_fault.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names],
        F.coalesce(F.min(frequent)["name"], F.lit("NONE")).alias("dominant_fault_type"),
        F.coalesce(mean, F.lit(0.20).cast(CONFIDENCE)).alias("avg_confidence"),
        *[F.max_by(c, "__place").alias(c) for c in newest],
    )


def feature_stats(
    events: DataFrame, as_of, lookback_seconds: float = FEATURE_LOOKBACK_SECONDS, systems: DataFrame | None = None
) -> DataFrame:
    """Statistics per host over the lookback, optionally only for the hosts listed in ``systems``."""
    recent = events.filter(in_window(F.col("ingested_at"), as_of, lookback_seconds))
    if systems is not None:
        recent = recent.join(systems.select("system_id"), "system_id", "left_semi")
    return combined_stats(recent, ["system_id"])


def host_feature_stats(events: DataFrame, system_id: str, as_of, lookback_seconds: float = FEATURE_LOOKBACK_SECONDS) -> DataFrame:
    """Single-host form: always one row, zeros when the host was silent."""
    mine = events.filter((F.col("system_id") == system_id) & in_window(F.col("ingested_at"), as_of, lookback_seconds))
    return combined_stats(mine, [])


def zero_filled(heartbeats: DataFrame, stats: DataFrame) -> DataFrame:
    """Every heartbeat host gets a statistics row; silent hosts get zeros, NONE and 0.20."""
    joined = heartbeats.join(stats, "system_id", "left")
    filled = {
        name: F.coalesce(F.col(name), F.lit(value).cast(SNAPSHOTS[name].dataType)) for name, value in ZERO_STATS.items()
    }
    return joined.withColumns(filled)


def snapshot_cycle(heartbeats: DataFrame, events: DataFrame, as_of, lookback_seconds: float = FEATURE_LOOKBACK_SECONDS) -> DataFrame:
    """One snapshot row per heartbeat host: current readings plus statistics over the lookback.

    The event side is restricted by time, not by the host list: the left join drops other hosts anyway and the
    semi join would only add a shuffle.
    """
    stats = feature_stats(events, as_of, lookback_seconds)
    rows = zero_filled(heartbeats, stats).withColumn("snapshot_time", at(as_of))
    return conform(rows, SNAPSHOTS, SNAPSHOT_DEFAULTS)


def windowed_snapshots(events: DataFrame, lookback_seconds: int, interval_seconds: int | None = None) -> DataFrame:
    """Snapshots for every interval at once: sliding windows when the interval is shorter than the lookback.

    Readings are the newest ones in the window, as a heartbeat would carry them.
    """
    every = interval_seconds or lookback_seconds
    win = F.window("ingested_at", f"{lookback_seconds} seconds", f"{every} seconds")
    placed = events.withColumn("snapshot_time", win["start"])
    readings = ("cpu_usage_percent", "memory_usage_percent", "disk_free_percent")
    rows = combined_stats(placed, ["system_id", "snapshot_time"], readings, time_and_id("ingested_at", "id"))
    return conform(rows, SNAPSHOTS, SNAPSHOT_DEFAULTS)


def read_snapshots(snapshots: DataFrame, system_id: str | None = None, limit: int = 100) -> DataFrame:
    """Newest snapshots with every NULL replaced by its default."""
    rows = snapshots.filter(F.col("system_id") == system_id) if system_id else snapshots
    newest = rows.orderBy(F.col("snapshot_time").desc(), F.col("system_id")).limit(limit)
    return conform(newest, SNAPSHOTS, SNAPSHOT_DEFAULTS)


def training_batch(snapshots: DataFrame, limit: int = 100) -> DataFrame:
    """Newest snapshots over all hosts."""
    return snapshots.orderBy(F.col("snapshot_time").desc(), F.col("system_id")).limit(limit)


def latest_readings(points: DataFrame) -> DataFrame:
    """Cast a (host, time, cpu, memory, disk) series to the stored precision."""
    return points.withColumns(
        {c: F.col(c).cast(PERCENT) for c in ("cpu_usage_percent", "memory_usage_percent", "disk_free_percent")}
    )
