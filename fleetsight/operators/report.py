"""Event report: counters, patterns, insights, resource alerts, text and CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.functions.severity import level_name
from fleetsight.operators.classify import detect_errors
from fleetsight.schemas import CPU_ALERT, DISK_ALERT, MEMORY_ALERT

TOP_DIMENSIONS = {"provider": 10, "event_code": 10}
#: Parts of a dimension's values in the report counters.
PARTS = 16


def report_counters(events: DataFrame, top: dict[str, int] | None = None) -> DataFrame:
    """Counts by channel, level, fault, provider (top 10) and code (top 10, with the earliest event's provider).

    The five groupings share one scan and one shuffle: each event becomes five (dimension, value) pairs that are
    combined before the shuffle. No task sees all values of a dimension, see ``_positions``.
    """
    top = TOP_DIMENSIONS if top is None else top
    dims = {
        "channel": F.col("log_channel"),
        "level": F.col("level").cast("string"),
        "fault": F.coalesce("fault_type", F.lit("UNKNOWN")),
        "provider": F.col("provider_name"),
        "event_code": F.col("event_code").cast("string"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in dims.items()]))
    rows = events.select(pairs.alias("p"), "provider_name", "ingested_at", "id")
    counts = rows.groupBy("p.dimension", "p.value").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("provider_name", F.struct("ingested_at", "id")).alias("example")
    )
    ranked = _positions(counts, top)
    example = F.when(F.col("dimension") == "event_code", F.coalesce("example", F.lit("Unknown")))
    return ranked.withColumn("example", example)


def _positions(counts: DataFrame, top: dict[str, int]) -> DataFrame:
    """Group rows with their position in their dimension and percent of it, the dimensions in ``top`` cut to their first.

    The rows of a dimension are dealt to ``PARTS`` parts. A cut dimension keeps the first of each part, which hold the
    first of all. A position is the place among equal counts plus the number of values with a larger count; every part
    learns those numbers from a row per distinct count, and the total from a row per part, copied to all parts.
    """
    part = Window.partitionBy("dimension", "__part")
    first = F.row_number().over(part.orderBy(F.col("count").desc(), F.col("value")))
    rows = counts.withColumn("__part", F.pmod(F.hash("value"), F.lit(PARTS)))
    rows = rows.withColumns({"__first": first, "__sum": F.sum("count").over(part)})
    wanted = F.lit(None).cast("int")
    for name, k in top.items():
        wanted = F.when(F.col("dimension") == name, k).otherwise(wanted)
    rows = rows.filter(wanted.isNull() | (F.col("__first") <= wanted))
    ties = Window.partitionBy("dimension", "count")
    rows = rows.withColumns({"__place": F.row_number().over(ties.orderBy("value")), "__ties": F.count(F.lit(1)).over(ties)})
    told = (F.col("__first") == 1) | (F.col("__place") == 1)
    to = F.when(told, F.sequence(F.lit(-1), F.lit(PARTS - 1))).otherwise(F.array(F.lit(-1)))
    rows = rows.withColumn("__to", F.explode(to))
    copy = F.col("__to") >= 0
    rows = rows.withColumns(
        {
            "__part": F.when(copy, F.col("__to")).otherwise(F.col("__part")),
            "__ties": F.when(copy & (F.col("__place") == 1), F.col("__ties")),
            "__sum": F.when(copy & (F.col("__first") == 1), F.col("__sum")),
            **{c: F.when(~copy, F.col(c)) for c in ("value", "example")},
        }
    )
    larger = part.orderBy(F.col("count").desc()).rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__ties").over(larger), F.lit(0))
    rows = rows.withColumns({"position": (F.col("__place") + before).cast("int"), "__total": F.sum("__sum").over(part)})
    percent = F.round(F.col("count") * 100.0 / F.col("__total"), 1)
    kept = rows.filter(~copy & (wanted.isNull() | (F.col("position") <= wanted)))
    return kept.select("dimension", "value", "count", "example", "position", percent.alias("percent"))


def resource_usage(events: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of the readings at capture time, one row per metric."""
    metrics = [("CPU %", "cpu_usage_percent"), ("Memory %", "memory_usage_percent"), ("Disk Free %", "disk_free_percent")]
    aggs = []
    for i, (_, c) in enumerate(metrics):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.round(F.avg(c), 1).alias(f"av{i}")]
    rows = [
        F.struct(
            F.lit(label).alias("metric"),
            F.col(f"lo{i}").cast("double").alias("min"),
            F.col(f"hi{i}").cast("double").alias("max"),
            F.col(f"av{i}").cast("double").alias("avg"),
        )
        for i, (label, _) in enumerate(metrics)
    ]
    return events.agg(*aggs).select(F.inline(F.array(*rows)))


def fault_patterns(errors: DataFrame, k: int = 15) -> DataFrame:
    """Top (provider, code, title) patterns of detected errors."""
    return (
        errors.groupBy("provider_name", "event_code", "title")
        .agg(F.count(F.lit(1)).alias("count"), F.bool_or("known").alias("known"))
        .orderBy(F.col("count").desc(), "provider_name", "event_code", "title")
        .limit(k)
    )


def error_levels(errors: DataFrame) -> DataFrame:
    return errors.agg(
        F.count(F.lit(1)).alias("issues"),
        *[F.count_if(F.col("level") == n).alias(name) for n, name in ((1, "critical"), (2, "error"), (3, "warning"))],
    )


def root_causes(errors: DataFrame) -> DataFrame:
    """One row per known (provider, code) with how often its pattern occurred.

    Title, diagnosis, causes and solutions are functions of the key, so they are grouping columns.
    """
    known = errors.filter("known")
    return known.groupBy("provider_name", "event_code", "title", "diagnosis", "causes", "solutions").agg(
        F.count(F.lit(1)).alias("count"), F.min("level").alias("worst_level")
    )


def _has(name: str, needle: str) -> Column:
    return F.contains(F.coalesce(F.col(name), F.lit("")), F.lit(needle))


def pattern_insights(events: DataFrame) -> DataFrame:
    """Insights whose count exceeds its threshold, in fixed order."""
    counts = {
        "warning": (F.col("level") == 3, 100, "{} warning events collected — review patterns for recurring issues"),
        "dcom": (_has("provider_name", "DistributedCOM"), 50, "High DCOM event count ({}) — typically benign but reducible via permissions config"),
        "pnp": (_has("provider_name", "Kernel-PnP"), 20, "Multiple Plug-and-Play events ({}) — consider updating device drivers"),
        "throttle": (
            _has("provider_name", "Processor-Power") & (F.col("event_code") == 37),
            10,
            "CPU throttling detected ({} events) — check cooling and power settings",
        ),
        "wifi": (_has("provider_name", "Netwtw"), 15, "WiFi driver instability ({} events) — update Intel WiFi drivers"),
    }
    one = events.agg(*[F.count_if(cond).alias(name) for name, (cond, _, _) in counts.items()])
    rows = []
    for place, (name, (_, limit, text)) in enumerate(counts.items(), 1):
        head, rest = text.split("{}")
        message = F.concat(F.lit(head), F.col(name).cast("string"), F.lit(rest))
        row = F.struct(F.lit(place).alias("place"), F.col(name).alias("count"), message.alias("insight"))
        rows.append(F.when(F.col(name) > limit, row))
    return one.select(F.inline(F.array_compact(F.array(*rows))))


def resource_alerts(events: DataFrame) -> DataFrame:
    """High CPU, high memory and low disk rows (strict comparisons), only where the count is positive."""
    specs = [
        ("HIGH_CPU", "WARNING", F.col("cpu_usage_percent") > CPU_ALERT, f"CPU exceeded {CPU_ALERT}% during ", "Review running processes; check for CPU-intensive background tasks"),
        ("HIGH_MEMORY", "WARNING", F.col("memory_usage_percent") > MEMORY_ALERT, f"Memory exceeded {MEMORY_ALERT}% during ", "Identify memory-intensive processes; consider adding RAM"),
        ("LOW_DISK", "CRITICAL", F.col("disk_free_percent") < DISK_ALERT, f"Disk free below {DISK_ALERT}% during ", "Free disk space immediately; run Disk Cleanup"),
    ]
    one = events.agg(*[F.count_if(cond).alias(kind) for kind, _, cond, _, _ in specs])
    rows = [
        F.struct(
            F.lit(kind).alias("type"),
            F.lit(sev).alias("severity"),
            F.col(kind).alias("count"),
            F.concat(F.lit(head), F.col(kind).cast("string"), F.lit(" event capture(s)")).alias("message"),
            F.lit(action).alias("action"),
        )
        for kind, sev, _, head, action in specs
    ]
    return one.select(F.inline(F.array(*rows))).filter(F.col("count") > 0)


def annotate_events(events: DataFrame, errors: DataFrame) -> DataFrame:
    """Events of level 1 to 3 get title and diagnosis of their (provider, code); the newest error wins.

    Errors are reduced to one row per (provider, code) first, which is a small dimension.
    """
    dim = errors.groupBy("provider_name", "event_code").agg(
        F.max_by(F.struct("title", "diagnosis"), F.struct("event_time", "event_record_id")).alias("d")
    )
    dim = dim.select(F.col("provider_name").alias("__p"), F.col("event_code").alias("__c"), "d.title", "d.diagnosis")
    wanted = F.col("level").isin(1, 2, 3)
    cond = wanted & F.col("provider_name").eqNullSafe(F.col("__p")) & (F.col("event_code") == F.col("__c"))
    return events.join(dim, cond, "left").drop("__p", "__c")


def detail_lines(annotated: DataFrame) -> DataFrame:
    """One text block per event for the detailed report; descriptions keep 300 characters."""

    def one(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("decimal(12,1)").cast("string")

    def padded(c: Column, width: int, left: bool = False) -> Column:
        """Pads but never cuts."""
        pad = F.lpad if left else F.rpad
        return F.when(F.length(c) < width, pad(c, width, " ")).otherwise(c)

    head = F.concat(
        F.lit("["), padded(level_name(F.coalesce("level", F.lit(0))), 8), F.lit("] "),
        padded(F.coalesce("provider_name", F.lit("Unknown")), 50),
        F.lit(" EventID="), padded(F.coalesce(F.col("event_code"), F.lit(0)).cast("string"), 5, left=True),
        F.lit("  RecordID="), F.coalesce(F.col("id"), F.lit(0)).cast("string"),
    )
    usage = F.concat(
        F.lit("       Resources: CPU="), one("cpu_usage_percent"), F.lit("%  MEM="), one("memory_usage_percent"),
        F.lit("%  DISK="), one("disk_free_percent"), F.lit("% free"),
    )
    lines = F.array_compact(
        F.array(
            head,
            F.concat(F.lit("       Time    : "), F.col("ingested_at").cast("string")),
            F.concat(F.lit("       Channel : "), F.coalesce("log_channel", F.lit("Unknown"))),
            usage,
            F.concat(F.lit("       Desc    : "), F.substring("event_message", 1, 300)),
            F.concat(F.lit("       ┌─ "), F.col("title")),
            F.concat(F.lit("       │  "), F.col("diagnosis")),
        )
    )
    return annotated.select("id", F.array_join(lines, "\n").alias("block"))


def csv_export(events: DataFrame) -> DataFrame:
    """CSV lines: only the message is quoted, with quotes doubled."""
    message = F.coalesce(F.col("fault_description"), F.col("fault_type"), F.lit(""))
    return events.select(
        "id",
        F.concat_ws(
            ",",
            F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
            F.coalesce("severity", F.lit("")),
            F.coalesce("hostname", F.lit("")),
            F.coalesce("provider_name", F.lit("")),
            F.coalesce("fault_type", F.lit("")),
            F.concat(F.lit('"'), F.regexp_replace(message, '"', '""'), F.lit('"')),
        ).alias("line"),
    )


def summary_report(kpis: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """One JSON document from the KPI row and the (at most 25) failing hosts."""
    tagged = kpis.select(F.to_json(F.struct("*")).alias("k"), F.lit(None).cast("string").alias("f"), F.lit(0).alias("pos"))
    listed = failures.select(
        F.lit(None).cast("string").alias("k"),
        F.to_json(F.struct("system_id", "hostname", "failure_count")).alias("f"),
        (-F.col("failure_count")).cast("int").alias("pos"),
    )
    rows = tagged.unionByName(listed)
    items = F.sort_array(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("pos", "f"))))
    one = rows.agg(F.max("k").alias("k"), F.array_join(F.transform(items, lambda x: x["f"]), ",").alias("fs"))
    return one.select(
        F.concat(
            F.lit('{"generated_at":"'), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('","dashboard_metrics":'),
            F.col("k"), F.lit(',"system_failures":['), F.col("fs"), F.lit("]}"),
        ).alias("report")
    )


def analysis_report(events: DataFrame, xml: str | None = None) -> dict[str, DataFrame]:
    """All sections of the analysis report as lazy DataFrames.

    Sections that read detected errors share one definition; persist it before running them all.
    """
    errors = detect_errors(events, xml)
    return {
        "counters": report_counters(events),
        "resources": resource_usage(events),
        "insights": pattern_insights(events),
        "alerts": resource_alerts(events),
        "levels": error_levels(errors),
        "patterns": fault_patterns(errors),
        "root_causes": root_causes(errors),
    }
