"""Bucketed metrics, KPIs, distributions and ingest health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.functions.clock import before, between, in_window, time_bucket
from fleetsight.functions.coerce import js_round
from fleetsight.functions.ordered import neighbour_in_time
from fleetsight.functions.severity import severity_rank
from fleetsight.operators.features import severity_counts
from fleetsight.schemas import SEVERITIES

HOUR = 3600


def metric_bucket_seconds(window_minutes: int | None) -> int:
    """Up to an hour 5 minutes, up to six hours 15 minutes, else an hour."""
    minutes = window_minutes or 1440
    return 300 if minutes <= 60 else 900 if minutes <= 360 else HOUR


def _averages(decimals: int = 1) -> list[Column]:
    return [
        F.round(F.avg("cpu_usage_percent"), decimals).alias("avg_cpu"),
        F.round(F.avg("memory_usage_percent"), decimals).alias("avg_memory"),
        F.round(F.avg("disk_free_percent"), decimals).alias("avg_disk_free"),
    ]


def bucketed_metrics(
    events: DataFrame, as_of=None, window_minutes: int | None = None, start=None, end=None, bucket_seconds: int | None = None
) -> DataFrame:
    """Counts per severity and average readings per time bucket.

    One hash aggregate with partial combine; the number of groups is the number of buckets.
    """
    if start is not None and end is not None:
        rows = events.filter(between(F.col("ingested_at"), start, end))
    else:
        rows = events.filter(in_window(F.col("ingested_at"), as_of, (window_minutes or 1440) * 60))
    seconds = bucket_seconds or metric_bucket_seconds(window_minutes)
    return (
        rows.groupBy(time_bucket(F.col("ingested_at"), seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("event_count"), *severity_counts(), *_averages())
        .orderBy("bucket")
    )


def snapshot_metrics(snapshots: DataFrame, as_of, window_seconds: float = 24 * HOUR) -> DataFrame:
    """Hourly rollup of snapshots, the fallback for bucketed metrics."""
    rows = snapshots.filter(in_window(F.col("snapshot_time"), as_of, window_seconds))
    sums = {
        "event_count": "total_events",
        "critical_count": "critical_count",
        "error_count": "error_count",
        "warning_count": "warning_count",
        "info_count": "info_count",
    }
    return (
        rows.groupBy(F.date_trunc("hour", "snapshot_time").alias("bucket"))
        .agg(*[F.sum(src).alias(out) for out, src in sums.items()], *_averages())
        .orderBy("bucket")
    )


def kpis(events: DataFrame, as_of, window_minutes: int | None = None) -> DataFrame:
    rows = events.filter(in_window(F.col("ingested_at"), as_of, window_minutes * 60, inclusive=True)) if window_minutes else events
    return rows.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_events"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_events"),
    )


def kpis_from_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_events"),
        F.coalesce(F.sum("warning_count"), F.lit(0)).alias("warning_events"),
    )


def kpis_or_snapshots(events: DataFrame, snapshots: DataFrame, as_of, window_minutes: int | None = None) -> DataFrame:
    """KPIs from events, or from snapshots when the window holds no event. Both are one-row aggregates."""
    both = kpis(events, as_of, window_minutes).withColumn("choice", F.when(F.col("total_events") > 0, 1).otherwise(3))
    both = both.unionByName(kpis_from_snapshots(snapshots).withColumn("choice", F.lit(2)))
    return both.orderBy("choice").limit(1).drop("choice")


def distribution(events: DataFrame, column: str, as_of=None, window_minutes: int | None = None) -> DataFrame:
    """Rows per value, NULL being a value of its own."""
    rows = events.filter(in_window(F.col("ingested_at"), as_of, window_minutes * 60, inclusive=True)) if window_minutes else events
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col(column))


def severity_share(events: DataFrame, as_of=None, window_minutes: int | None = None) -> DataFrame:
    """Severity distribution with the percentage of the total (the window runs over at most a few group rows)."""
    counts = distribution(events, "severity", as_of, window_minutes)
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", js_round(F.col("count") * 100.0 / total))


def severity_counts_zero_filled(events: DataFrame) -> DataFrame:
    """All four severities, zero when absent."""
    names = F.explode(F.array(*[F.lit(s) for s in reversed(SEVERITIES)])).alias("severity")
    total = events.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return total.select(names, *SEVERITIES).select(
        "severity", F.coalesce(*[F.when(F.col("severity") == s, F.col(s)) for s in SEVERITIES]).alias("count")
    )


def top_values(events: DataFrame, column: str, k: int) -> DataFrame:
    return distribution(events, column).limit(k)


def fleet_averages(heartbeats: DataFrame, events: DataFrame, as_of, heartbeat_seconds: float = 300, event_seconds: float = HOUR) -> DataFrame:
    """Average readings of hosts seen lately; when CPU and memory are both 0 the events of the last hour decide."""

    def averages(rows: DataFrame, source: int) -> DataFrame:
        cols = [
            F.coalesce(F.round(F.avg(c), 1), F.lit(0)).cast("double").alias(a)
            for c, a in (("cpu_usage_percent", "avg_cpu"), ("memory_usage_percent", "avg_memory"), ("disk_free_percent", "avg_disk"))
        ]
        return rows.agg(*cols).withColumn("source", F.lit(source))

    fresh = averages(heartbeats.filter(in_window(F.col("last_seen"), as_of, heartbeat_seconds)), 1)
    fresh = fresh.withColumn("source", F.when((F.col("avg_cpu") == 0) & (F.col("avg_memory") == 0), 3).otherwise(1))
    spare = averages(events.filter(in_window(F.col("ingested_at"), as_of, event_seconds)), 2)
    return fresh.unionByName(spare).orderBy("source").limit(1).drop("source")


def export_totals(snapshots: DataFrame, events: DataFrame, as_of, online_seconds: float = 2 * HOUR) -> DataFrame:
    """Totals for metric export plus the number of hosts with events in the last two hours."""
    totals = snapshots.agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_events"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("error_events"),
        F.coalesce(F.sum("warning_count"), F.lit(0)).alias("warning_events"),
        F.coalesce(F.sum("info_count"), F.lit(0)).alias("info_events"),
        F.coalesce(F.round(F.avg("cpu_usage_percent"), 2), F.lit(0)).cast("double").alias("avg_cpu"),
        F.coalesce(F.round(F.avg("memory_usage_percent"), 2), F.lit(0)).cast("double").alias("avg_memory"),
        F.coalesce(F.round(F.avg("disk_free_percent"), 2), F.lit(0)).cast("double").alias("avg_disk_free"),
        F.countDistinct("system_id").alias("total_systems"),
    )
    online = events.filter(in_window(F.col("ingested_at"), as_of, online_seconds)).agg(
        F.countDistinct("system_id").alias("online_systems")
    )
    names = totals.columns
    rows = totals.withColumn("online_systems", F.lit(0).cast("bigint")).unionByName(
        online.select(*[F.lit(0).cast(totals.schema[c].dataType).alias(c) for c in names], "online_systems")
    )
    return rows.agg(*[F.sum(c).alias(c) for c in [*names, "online_systems"]])


def export_totals_from_events(events: DataFrame, as_of, window_seconds: float = 24 * HOUR, online_seconds: float = 2 * HOUR) -> DataFrame:
    """The same totals straight from events, used when there are no snapshots."""
    online = in_window(F.col("ingested_at"), as_of, online_seconds)
    rows = events.filter(in_window(F.col("ingested_at"), as_of, max(window_seconds, online_seconds)))
    inside = in_window(F.col("ingested_at"), as_of, window_seconds)

    def count(sev: str | None) -> Column:
        return F.count_if(inside if sev is None else inside & (F.col("severity") == sev))

    def mean(name: str) -> Column:
        return F.coalesce(F.round(F.avg(F.when(inside, F.col(name))), 2), F.lit(0)).cast("double")

    return rows.agg(
        count(None).alias("total_events"),
        count("CRITICAL").alias("critical_events"),
        count("ERROR").alias("error_events"),
        count("WARNING").alias("warning_events"),
        count("INFO").alias("info_events"),
        mean("cpu_usage_percent").alias("avg_cpu"),
        mean("memory_usage_percent").alias("avg_memory"),
        mean("disk_free_percent").alias("avg_disk_free"),
        F.countDistinct(F.when(inside, F.col("system_id"))).alias("total_systems"),
        F.countDistinct(F.when(online, F.col("system_id"))).alias("online_systems"),
    )


# Exported metric names (without prefix) and their help text.
EXPORTED = [
    ("total_events", "Total telemetry events."),
    ("critical_events", "CRITICAL severity events."),
    ("error_events", "ERROR severity events."),
    ("warning_events", "WARNING severity events."),
    ("info_events", "INFO severity events."),
    ("avg_cpu", "Average CPU usage percent."),
    ("avg_memory", "Average memory usage percent."),
    ("avg_disk_free", "Average disk free percent."),
    ("total_systems", "Total distinct systems."),
    ("online_systems", "Systems active in last 2 hours."),
]


def exposition_lines(totals: DataFrame, prefix: str = "fleet") -> DataFrame:
    """``# HELP`` / ``# TYPE`` / value lines, ordered by ``line_no``."""
    lines = []
    for name, text in EXPORTED:
        metric = f"{prefix}_{name}"
        lines += [
            F.lit(f"# HELP {metric} {text}"),
            F.lit(f"# TYPE {metric} gauge"),
            F.concat(F.lit(f"{metric} "), F.col(name).cast("string")),
        ]
    return totals.select(F.posexplode(F.array(*lines)).alias("line_no", "line")).orderBy("line_no")


def throughput(events: DataFrame, as_of, window_seconds: float = 300, write_seconds: float = 60, newest: Column | None = None) -> DataFrame:
    """Events per second now and in the window before, the change in percent, the write rate and the lag.

    One scan of two windows, which the time filter prunes, with conditional aggregates. The lag uses the newest event
    inside them; for a table that has been silent for longer it is the age of ``newest`` (a time known from elsewhere,
    such as the newest heartbeat), or the width of the scan if none is given.
    """
    ts = F.col("ingested_at")
    reach = max(2 * window_seconds, write_seconds)
    events = events.filter(in_window(ts, as_of, reach))
    now, prev = in_window(ts, as_of, window_seconds), in_window(ts, as_of, 2 * window_seconds)
    last = events.agg(
        F.count_if(now).alias("n_now"),
        F.min(F.when(now, ts)).alias("lo_now"),
        F.max(F.when(now, ts)).alias("hi_now"),
        F.count_if(prev & ~now).alias("n_prev"),
        F.min(F.when(prev & ~now, ts)).alias("lo_prev"),
        F.max(F.when(prev & ~now, ts)).alias("hi_prev"),
        F.count_if(in_window(ts, as_of, write_seconds)).alias("n_write"),
        F.max(ts).alias("latest"),
    )

    def span(hi: str, lo: str) -> Column:
        return (F.unix_micros(hi) - F.unix_micros(lo)) / F.lit(1_000_000.0)

    def rate(n: str, hi: str, lo: str) -> Column:
        return F.when(span(hi, lo) > 0, F.col(n) / span(hi, lo)).otherwise(0.0)

    known = [F.col("latest"), *([newest] if newest is not None else []), before(as_of, reach)]
    age = (F.unix_micros(before(as_of, 0)) - F.unix_micros(F.coalesce(*known))) / F.lit(1_000_000.0)
    return (
        last.withColumn("events_per_sec", F.round(rate("n_now", "hi_now", "lo_now"), 1))
        .withColumn("prev", rate("n_prev", "hi_prev", "lo_prev"))
        .select(
            "events_per_sec",
            F.when(F.col("prev") > 0, F.bround((F.col("events_per_sec") - F.col("prev")) / F.col("prev") * 100, 0))
            .otherwise(0.0)
            .cast("bigint")
            .alias("eps_change_pct"),
            F.round(F.col("n_write") / F.lit(60.0), 1).alias("db_write_rate"),
            F.when(age > 300, age.cast("bigint")).otherwise(0).alias("ingest_lag"),
            F.when(age > 300, "Degraded").otherwise("Optimal").alias("lag_status"),
        )
    )


def mean_gap(events: DataFrame, as_of, window_seconds: float = 300) -> DataFrame:
    """Mean time between events of the same host in milliseconds.

    The gaps of one host telescope to newest - oldest, so a plain aggregate replaces the per-host LAG window.
    """
    recent = events.filter(in_window(F.col("ingested_at"), as_of, window_seconds))
    us = F.unix_micros("ingested_at")
    per_host = recent.groupBy("system_id").agg((F.max(us) - F.min(us)).alias("span"), (F.count(F.lit(1)) - 1).alias("gaps"))
    total = per_host.agg(F.sum("span").alias("span"), F.sum("gaps").alias("gaps"))
    return total.select(
        F.coalesce(F.round(F.try_divide(F.col("span") / F.lit(1000.0), F.col("gaps")), 0), F.lit(0.0))
        .cast("bigint")
        .alias("avg_latency_ms")
    )


def minute_trend(events: DataFrame, as_of, window_seconds: float = 1200, bucket_seconds: int = 60) -> DataFrame:
    """Events per minute and the mean gap to the previous event of the whole stream.

    A global LAG would send every event to one task. Per bucket only min, max and count are needed: the gaps of a
    bucket telescope from the newest event of the bucket before it. The neighbour lookup then runs over bucket
    rows, chunked by day.
    """
    recent = events.filter(in_window(F.col("ingested_at"), as_of, window_seconds))
    us = F.unix_micros("ingested_at")
    buckets = recent.groupBy(time_bucket(F.col("ingested_at"), bucket_seconds).alias("bucket")).agg(
        F.min(us).alias("lo"), F.max(us).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    keyed = buckets.withColumn("__all", F.lit(0)).withColumn("__tie", F.lit(0))
    linked = neighbour_in_time(keyed, ["__all"], "bucket", "__tie", {"prev": "hi"}, 24 * HOUR)
    gaps = F.when(F.col("prev").isNull(), F.col("n") - 1).otherwise(F.col("n"))
    span = F.col("hi") - F.coalesce("prev", "lo")
    return (
        linked.select("bucket", gaps.alias("count"), F.round(span / F.lit(1000.0) / F.nullif(gaps, F.lit(0)), 0).cast("bigint").alias("gap_ms"))
        .filter(F.col("count") > 0)
        .orderBy("bucket")
    )


def minute_trend_with_default(trend: DataFrame, gap: DataFrame) -> DataFrame:
    """Buckets with a zero gap take the overall per-host mean (``gap`` is a one-row frame used as a scalar)."""
    value = gap.select("avg_latency_ms").scalar()
    return trend.withColumn("gap_ms", F.when(F.col("gap_ms") > 0, F.col("gap_ms")).otherwise(value))


def adaptive_buckets(events: DataFrame, as_of, window_minutes: int) -> DataFrame:
    """Metrics whose bucket width follows the time span actually covered by the events."""
    recent = events.filter(F.col("ingested_at") >= before(as_of, window_minutes * 60))
    span = recent.agg(((F.max(F.unix_micros("ingested_at")) - F.min(F.unix_micros("ingested_at"))) / 1_000_000).alias("s")).first()[0]
    seconds = HOUR
    for limit, width in ((15 * 60, 30), (HOUR, 60), (6 * HOUR, 300), (24 * HOUR, 900)):
        if span is not None and span <= limit:
            seconds = width
            break
    means = [
        F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(a)
        for c, a in (("cpu_usage_percent", "avg_cpu"), ("memory_usage_percent", "avg_memory"), ("disk_free_percent", "avg_disk_free"))
    ]
    return (
        recent.groupBy(time_bucket(F.col("ingested_at"), seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("event_count"), *severity_counts(), *means)
        .orderBy("bucket")
    )


def facet_faults(events: DataFrame) -> DataFrame:
    return events.select("fault_type").distinct().orderBy("fault_type")


def facet_systems(systems: DataFrame) -> DataFrame:
    return systems.select("system_id", "hostname").distinct().orderBy("hostname", "system_id")


def worst_severity() -> Column:
    return F.max(severity_rank(F.col("severity")))
